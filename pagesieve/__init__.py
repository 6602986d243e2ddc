"""pagesieve: audit operators for crawled web text, written as Spark DataFrame transformations."""
