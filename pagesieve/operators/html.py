"""Scripts, handlers and links inside HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.text import decode_references
from pagesieve.functions.url import netloc, with_join

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""
# Comments, whole script and style elements, and open tags: markup inside a comment,
# a script or a style sheet is not markup.
TOKEN = (
    r"(?s)<!--.*?(?:-->|\z)"
    rf"|<(?i:script)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</(?i:script)[^>]*>|\z)"
    rf"|<(?i:style)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</(?i:style)[^>]*>|\z)"
    rf"|<[a-zA-Z]{_ATTRIBUTES}>"
)
_OPEN_TAG = rf"^<[a-zA-Z]{_ATTRIBUTES}>"
_NAME = r"^<([a-zA-Z][^\s/>]*)"
_ATTRIBUTE = r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']*))?"""

# Elements and attributes searched for handlers; link prefixes left out.
HANDLER_TAGS = ["a", "form", "button", "input", "div", "span"]
HANDLER_ATTRIBUTES = ["onclick", "onload", "onerror", "onmouseover"]
SKIPPED_LINKS = ["#", "javascript:", "mailto:", "tel:"]


def tags(pages: DataFrame, *, url: str = "url", html: str = "html", names: list[str]) -> DataFrame:
    """Elements called ``names``: page, position among the page's tokens, name, open tag, script body."""
    found = pages.select(
        F.col(url).alias("page_url"),
        F.posexplode_outer(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))).alias("tag_ord", "_token"),
    )
    found = found.withColumn("tag", F.lower(F.regexp_extract("_token", _NAME, 1))).filter(F.col("tag").isin(names))
    opened = F.regexp_extract("_token", _OPEN_TAG, 0)
    found = found.withColumn("_open", opened)
    body = F.substring("_token", F.length("_open") + 1, F.length("_token"))
    return found.select(
        "page_url", "tag_ord", "tag", "_open",
        F.regexp_replace(body, r"(?is)</script[^>]*>\z", "").alias("body"),
    )


def attribute(found: DataFrame, wanted: list[str]) -> DataFrame:
    """One row per attribute in ``wanted`` of each tag; of repeated ones the last counts.  Character references are decoded."""
    inner = F.regexp_replace("_open", _NAME, "")
    names = F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(1)), lambda n: F.lower(n))
    values = F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(2))
    pairs = F.arrays_zip(names.alias("n"), values.alias("v"))
    found = found.withColumn("_pairs", pairs)

    def last(a: str) -> Column:
        value = F.try_element_at(F.filter("_pairs", lambda p: p["n"] == a), F.lit(-1))["v"]
        return F.struct(F.lit(a).alias("attribute"), value.alias("raw"))

    rows = found.select(
        "page_url", "tag_ord", "tag", F.explode_outer(F.array(*[last(a) for a in wanted])).alias("_a")
    ).select("page_url", "tag_ord", "tag", "_a.*").filter(F.col("raw").isNotNull())
    bare = F.regexp_extract("raw", r"""(?s)^(["']?)(.*)\1$""", 2)
    return rows.withColumn("value", decode_references(bare)).drop("raw")


def script_sources(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct absolute URLs of external scripts per page."""
    src = attribute(tags(pages, url=url, html=html, names=["script"]), ["src"])
    return with_join(src, "value", "page_url", "script_url").select("page_url", "script_url").distinct()


def inline_scripts(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Bodies of script elements that hold any text."""
    return tags(pages, url=url, html=html, names=["script"]).filter(F.col("body") != "").select(
        "page_url", "tag_ord", F.col("body").alias("content")
    )


def event_handlers(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Script text in handler attributes."""
    found = attribute(tags(pages, url=url, html=html, names=HANDLER_TAGS), HANDLER_ATTRIBUTES)
    return found.filter(F.col("value") != "").select(
        "page_url", "tag_ord", "tag", "attribute", F.col("value").alias("content")
    )


def links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Anchor targets as absolute URLs, one row per anchor."""
    found = attribute(tags(pages, url=url, html=html, names=["a"]), ["href"])
    found = found.filter(F.col("value") != "")
    for prefix in SKIPPED_LINKS:
        found = found.filter(~F.startswith(F.col("value"), F.lit(prefix)))
    return with_join(found, "value", "page_url", "link_url").select(
        "page_url", "tag_ord", F.col("value").alias("href"), "link_url"
    )


def internal(found: DataFrame) -> DataFrame:
    """Links to the host the page itself is on, port included."""
    return found.filter(netloc(F.col("link_url")) == netloc(F.col("page_url")))
