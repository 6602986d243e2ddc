"""Whole reports: one JSON document, or text in sections, as part files that follow one another.

A report is a table of lines with their place in it. Headings are rows of their own, one for each section, counted by
an aggregate; they share the section's sort key, so no task ever carries a heading over to the next. The lines are
sorted by ranges and written in parallel: the part files, in the order of their names, are the report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.catalog.js_categories import CATEGORIES
from pagesieve.catalog.vuln_rules import SEVERITY_RANK
from pagesieve.functions.storage import materialize, scratch
from pagesieve.functions.text import UNIVERSAL_LINES, strip
from pagesieve.functions.totals import size
from pagesieve.operators import comments as _comments
from pagesieve.operators import responses as _responses
from pagesieve.operators import urls as _urls
from pagesieve.operators.findings import enrich, rank, severity_counts
from pagesieve.sources.sinks import finding_block, severity_line

RULE = "=" * 78
THIN = "-" * 78
ORDER = ["part", "section", "place", "nth", "line"]
#: Categories that a Markdown report calls by a name of their own.
# Their titles.
TITLES = {
    "api_endpoints": "API Endpoints", "file_paths": "File Paths", "parameters": "Parameters", "secrets": "🚨 Secrets/Credentials",
    "urls": "URLs", "function_names": "Function Names", "class_names": "Class Names", "imports": "Imports", "comments": "Comments",
    "dom_selectors": "DOM Selectors", "event_handlers": "Event Handlers", "ajax_calls": "AJAX Calls", "websockets": "WebSockets",
    "local_storage_keys": "LocalStorage Keys", "cookies": "Cookies", "headers": "HTTP Headers", "regex_patterns": "Regex Patterns",
    "error_messages": "Error Messages", "debug_info": "Debug Info", "custom_patterns": "Custom Patterns",
}


def _lines(df: DataFrame, part: int, section: Column | str, place: Column, nth: Column, line: Column) -> DataFrame:
    """Lines of a report at their place: part, section (a text), place (numbers within it), nth (ties)."""
    section = F.lit(section) if isinstance(section, str) else section
    return df.select(
        F.lit(part).alias("part"), section.cast("string").alias("section"), place.cast("array<bigint>").alias("place"),
        nth.cast("bigint").alias("nth"), line.alias("line"),
    )


def _at(*numbers: Column | int) -> Column:
    return F.array(*[(F.lit(n) if isinstance(n, int) else n).cast("bigint") for n in numbers])


def _head(spark: SparkSession, lines: list[str]) -> DataFrame:
    rows = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("nth", "line"))
    return _lines(rows, 0, "", _at(0), F.col("nth"), F.col("line"))


def _together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def write_lines(report: DataFrame, path: str) -> None:
    """The lines of a report in order, as text files that follow one another by name."""
    report.orderBy(*ORDER).select("line").write.mode("overwrite").text(path)


# --- one JSON document -----------------------------------------------------------------------


def write_document(
    rows: DataFrame, path: str, *, order: list[Column | str], columns: list[str] | None = None, metadata: dict[str, Column] | None = None, name: str = "results"
) -> None:
    """One JSON document: ``{"metadata": {...}, name: [...]}``, or the bare array without ``metadata``.

    The elements are sorted by ``order``. They are written once under a number that grows along the sort; the least of these
    tells which element has no comma ahead of it, so the parts need nothing from one another. ``metadata`` are aggregates over the rows.
    """
    spark = rows.sparkSession
    columns = columns or rows.columns
    shown = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    numbered = rows.orderBy(*order).select(F.monotonically_increasing_id().alias("id"), shown.alias("line"), F.struct(*rows.columns).alias("row"))
    staged = materialize(numbered, scratch(spark, "document"))
    first = staged.agg(F.min("id").alias("id")).first().id
    body = staged.select("id", F.when(F.col("id") == first, F.col("line")).otherwise(F.concat(F.lit(","), "line")).alias("line"))
    start, end = F.lit("["), "]"
    facts = staged.select("row.*").agg(F.count("*").alias("_n"), *[c.alias(k) for k, c in (metadata or {}).items()])
    if metadata is not None:
        told = F.to_json(F.struct(*metadata), {"ignoreNullFields": "false"})
        start, end = F.concat(F.lit('{"metadata": '), told, F.lit(f', "{name}": [')), "]}"
    head = facts.select(F.lit(-1).cast("bigint").alias("id"), start.alias("line"))
    tail = spark.range(1).select(F.lit((1 << 63) - 1).alias("id"), F.lit(end).alias("line"))
    head.unionByName(body).unionByName(tail).orderBy("id").select("line").write.mode("overwrite").text(path)


# --- text ------------------------------------------------------------------------------------


def finding_report(found: DataFrame) -> DataFrame:
    """Findings with a title, how many of each severity, and a block for each, most severe first."""
    title = F.concat(F.lit(" Findings in scripts: "), F.col("n").cast("string"))
    bars = _head(found.sparkSession, [RULE])
    count = _lines(size(found), 0, "", _at(1), F.lit(0), F.concat(title, F.lit(f"\n{RULE}")))
    severities = severity_line(severity_counts(found))
    breakdown = _lines(severities, 0, "", _at(2), F.lit(0), F.concat(F.lit(" Severity breakdown: "), "line", F.lit(f"\n{THIN}")))
    rows = enrich(found)
    weight = F.lit(max(SEVERITY_RANK.values())) - rank(F.col("severity"))
    # most severe first, then by file: the weight leads the section
    section = F.concat(weight.cast("string"), F.lit("\x00"), "file")
    blocks = _lines(rows, 1, section, _at(F.col("line"), F.col("rule_ord")), F.col("offset"), F.concat(finding_block(), F.lit("\n")))
    return _together(bars, count, breakdown, blocks)


def item_report(items: DataFrame, corpus: DataFrame, *, text: str = "content") -> DataFrame:
    """Markdown: a section for each file, in it one for each category that has items."""
    files = corpus.filter(strip(F.col(text)) != "")
    head = _head(items.sparkSession, ["# Items of scripts", ""])
    count = _lines(size(files), 0, "", _at(1), F.lit(0), F.concat(F.lit("**Files Analyzed:** "), F.col("n").cast("string"), F.lit("\n")))
    paths = _lines(files, 1, F.col("path"), _at(-1), F.lit(0), F.concat(F.lit("\n## "), "path", F.lit("\n")))
    titles = F.create_map(*[F.lit(x) for c in [*CATEGORIES, "custom_patterns"] for x in (c, TITLES.get(c, c))])
    groups = items.groupBy("path", "category_ord", "category").agg(F.count("*").alias("n"))
    names = _lines(groups, 1, F.col("path"), _at(F.col("category_ord"), -1), F.lit(0), F.concat(F.lit("### "), titles[F.col("category")], F.lit("\n")))
    ends = _lines(groups, 1, F.col("path"), _at(F.col("category_ord"), (1 << 31)), F.lit(0), F.lit(""))
    line = F.format_string("- `%s` (Line %d, %s)", "value", "line_number", "confidence")
    bullets = _lines(items, 1, F.col("path"), _at(F.col("category_ord"), F.col("line_number"), F.col("pattern_ord")), F.col("match_ord"), line)
    return _together(head, count, paths, names, bullets, ends)


def comment_report(found: DataFrame, corpus: DataFrame, source: str, generated: str | None = None) -> DataFrame:
    """Comments with the totals of the run, the time if told, and a section for each file that has any."""
    bar, thin = "=" * 72, "-" * 72
    stats = _comments.stats(found, corpus)
    totals = F.format_string(
        f"Source path         : %s\nFiles scanned       : %d\nFiles with comments : %d\nTotal comments      : %d\n{bar}\n",
        F.lit(source), "files_scanned", F.coalesce("files_with_comments", F.lit(0).cast("bigint")), F.coalesce("total_comments", F.lit(0).cast("bigint")),
    )
    head = _head(found.sparkSession, [bar, "  COMMENTS", bar, *([f"Generated           : {generated}"] if generated else [])])
    total = _lines(stats, 0, "", _at(1), F.lit(0), totals)
    files = found.groupBy("path", "language").agg(F.count("*").alias("n"))
    opened = F.format_string(f"{thin}\nFILE     : %s\nLANGUAGE : %s\nCOMMENTS : %d\n{thin}", "path", "language", "n")
    heads = _lines(files, 1, F.col("path"), _at(-1), F.lit(0), opened)
    ends = _lines(files, 1, F.col("path"), _at(1 << 40), F.lit(0), F.lit(""))
    span = F.concat(F.lit("L"), F.col("line_start").cast("string"), F.when(F.col("line_end") != F.col("line_start"), F.concat(F.lit("-L"), F.col("line_end").cast("string"))).otherwise(""))
    tag = F.concat(F.lit("  ["), F.when(F.col("type") == "line", "LINE ").otherwise("BLOCK"), F.lit(" "), span, F.lit("]"))
    shown = F.array_join(F.transform(F.expr(UNIVERSAL_LINES.format("text")), lambda x: F.concat(F.lit("    "), x, F.lit(f"\n{thin}"))), "\n")
    body = _lines(found, 1, F.col("path"), _at(F.col("offset")), F.lit(0), F.concat_ws("\n", tag, shown, F.lit("")))
    return _together(head, total, heads, body, ends)


def url_report(urls: DataFrame, domain: str, scope: list[str] | None = None) -> DataFrame:
    """The summary of an inventory, one labelled count a line."""
    bar = "=" * 53
    head = _head(urls.sparkSession, [bar, f"           URL INVENTORY OF {domain.upper()}", bar, ""])
    counts = _urls.summary(urls, scope)
    # The labels.
    labels = {
        "total_urls": "[+] Total Distinct URLs Discovered : ", "clean_paths": "[+] Clean Directory Paths Found     : ",
        "important_paths": "[+] Critical/Important Paths Found  : ", "unique_parameters": "[+] Unique URL Parameter Keys Found : ",
    }
    if scope is not None:
        labels["out_of_scope_dropped"] = "[+] Out-of-scope URLs Dropped       : "
    rows = counts.select(F.posexplode(F.array(*[F.concat(F.lit(t), F.col(c).cast("string")) for c, t in labels.items()])).alias("nth", "line"))
    end = _lines(urls.sparkSession.range(1), 2, "", _at(0), F.lit(0), F.lit(f"\n{bar}"))
    return _together(head, _lines(rows, 1, "", _at(0), F.col("nth"), F.col("line")), end)


def difference_report(responses: DataFrame) -> DataFrame:
    """Each base URL whose responses differ, then its URLs, then an empty line."""
    pairs = _responses.differences(responses)
    bases = pairs.select("base_url").distinct()
    heads = _lines(bases, 1, F.col("base_url"), _at(0), F.lit(0), F.concat(F.lit("\U0001F525 "), "base_url"))
    ends = _lines(bases, 1, F.col("base_url"), _at(2), F.lit(0), F.lit(""))
    body = _lines(pairs, 1, F.col("base_url"), _at(1), F.lit(0), F.col("url"))
    return _together(heads, body, ends)


# --- several outputs of an inventory ---------------------------------------------------------


def write_inventory(urls: DataFrame, path: str, *, rows_per_file: int = 5_000_000) -> None:
    """URLs by category, clean and important paths, and parameter names, in one pass: ``path/output=<name>/``.

    Every URL becomes rows of (output, value), made distinct together. Each output's values are sorted and lie in files of at most
    ``rows_per_file`` rows, so a large output is dealt over many tasks.
    """
    clean = _urls.clean_path(F.col("url"))
    named = F.array(F.struct(F.lit("clean_paths").alias("output"), F.col("_path").alias("value")))
    important = F.when(_urls.is_important(F.col("_path")), F.array(F.struct(F.lit("important_paths").alias("output"), F.col("_path").alias("value"))))
    names = F.transform(_urls.parameters_of(F.col("url")), lambda n: F.struct(F.lit("parameters").alias("output"), n.alias("value")))
    nothing = F.array().cast("array<struct<output:string,value:string>>")
    of_url = F.concat(named, F.coalesce(important, nothing), F.coalesce(names, nothing))
    found = urls.select("url", clean.alias("_path")).select(F.inline(of_url))
    kinds = _urls.categories(urls).select(F.concat(F.lit("files_"), "category").alias("output"), F.col("url").alias("value"))
    rows = found.unionByName(kinds).distinct().repartitionByRange("output", "value").sortWithinPartitions("output", "value")
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("output").text(path)
