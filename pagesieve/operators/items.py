"""Categorised script items: endpoints, secrets, names, imports and two dozen more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.catalog.js_categories import CATEGORIES, CONFIDENCE_RANK, WHOLE_TEXT, detectors
from pagesieve.functions.regex import Rx, lookup
from pagesieve.functions.scan import extract_values, scan
from pagesieve.functions.text import clean_value, split_lines, strip, truncate
from pagesieve.functions.totals import one_row, size
from pagesieve.operators.endpoints import first_by

COLUMNS = [
    "path", "category", "value", "line_number", "context", "confidence", "category_ord",
    "pattern_ord", "match_ord",
]
# Order in which items are met: file, then category, line, detector, match.
ORDER = ["path", "category_ord", "line_number", "pattern_ord", "match_ord"]
CUSTOM = "custom_patterns"


def rank(confidence: Column) -> Column:
    """0 for the strongest confidence; 99 for an unknown one."""
    out = F.lit(99)
    for name, r in CONFIDENCE_RANK.items():
        out = F.when(confidence == name, r).otherwise(out)
    return out


def js_items(
    corpus: DataFrame,
    *,
    path: str = "path",
    text: str = "content",
    categories: list[str] | None = None,
    custom: list[tuple[str, str, str]] | None = None,
    min_length: int = 3,
    max_length: int = 500,
    exclude: list[str] | None = None,
    context: bool = False,
    corrected: bool = False,
) -> DataFrame:
    """Every item of the chosen categories, in long form and not yet deduplicated.

    ``custom`` adds (name, expression, confidence) detectors as one more category.
    Documents become lines and lines meet only the expressions whose substring
    test they pass, all without a shuffle.  ``context`` adds the neighbouring
    lines, which costs their length per item.
    """
    chosen = [c for c in CATEGORIES if categories is None or c in categories]
    docs = corpus.select(F.col(path).alias("path"), F.col(text).alias("_text"))
    docs = docs.filter(strip(F.col("_text")) != "")
    excluded = [f"(?diU){p}" for p in exclude or []]

    table = [
        (c, CATEGORIES.index(c), k, rx, confidence)
        for c in chosen if c not in WHOLE_TEXT
        for k, (rx, confidence) in enumerate(detectors(c, corrected))
    ]
    if custom and (categories is None or CUSTOM in categories):
        table += [
            (CUSTOM, len(CATEGORIES), k, Rx(rx, (), "s"), confidence or "medium")
            for k, (_, rx, confidence) in enumerate(custom)
        ]
    frames = []
    if table:
        frames.append(_line_items(docs, table, min_length, max_length, excluded, context))
    for c in chosen:
        if c in WHOLE_TEXT:
            frames.append(_whole_text_items(docs, c, max_length, excluded))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select(*COLUMNS)


def _attributes(table: list[tuple]) -> Column:
    """Catalog columns of a match, looked up by the ordinal of its expression."""
    return lookup("rx", [
        {"category": c, "category_ord": co, "pattern_ord": k, "confidence": conf}
        for c, co, k, _, conf in table
    ])


def _line_items(docs, table, min_length, max_length, excluded, context) -> DataFrame:
    lines = split_lines(F.col("_text"))
    keep = ["path", "line_number"]
    if context:
        def with_neighbours(line: Column, i: Column) -> Column:
            around = F.concat_ws(
                "\n", F.when(i > 0, F.get(F.col("_lines"), i - 1)), line, F.get(F.col("_lines"), i + 1)
            )
            return F.struct(line.alias("line"), strip(around).alias("context"))

        docs = docs.select("path", lines.alias("_lines"))
        rows = docs.select(
            "path", F.posexplode_outer(F.transform("_lines", with_neighbours)).alias("_i", "_l")
        ).select("path", (F.col("_i") + 1).alias("line_number"), "_l.*")
        keep = [*keep, "context"]
    else:
        rows = docs.select("path", F.posexplode_outer(lines).alias("_i", "line"))
        rows = rows.select("path", (F.col("_i") + 1).alias("line_number"), "line")
    found = extract_values(rows, "line", [t[3] for t in table], keep=keep)
    found = found.withColumn("value", clean_value(F.col("value"), max_length))
    found = found.filter((F.length("value") >= max(min_length, 1)))
    for p in excluded:
        found = found.filter(~F.col("value").rlike(p))
    found = found.withColumn("_a", _attributes(table))
    return found.select(
        "path", "_a.category", "value", "line_number",
        (F.col("context") if context else F.lit(None).cast("string")).alias("context"),
        "_a.confidence", "_a.category_ord", "_a.pattern_ord", F.col("nth").alias("match_ord"),
    )


def _whole_text_items(docs, category, max_length, excluded) -> DataFrame:
    """Comments: matched over the whole text, with delimiters, cut when long."""
    specs = detectors(category)
    found = scan(docs, "_text", [rx for rx, _ in specs], keep=["path"])
    found = found.withColumn("_v", strip(F.col("hit"))).filter(F.col("_v") != "")
    for p in excluded:
        found = found.filter(~F.col("_v").rlike(p))
    value = truncate(F.col("_v"), max_length)
    confidence = lookup("rx", [{"confidence": conf} for _, conf in specs])
    return found.withColumn("value", value).select(
        "path", F.lit(category).alias("category"), "value", F.col("line").alias("line_number"),
        truncate(F.col("value"), 200).alias("context"),
        confidence["confidence"].alias("confidence"),
        F.lit(CATEGORIES.index(category)).alias("category_ord"),
        F.col("rx").alias("pattern_ord"), F.col("nth").alias("match_ord"),
    )


def first_seen(items: DataFrame) -> DataFrame:
    """First item per (category, value) over the whole corpus; comments all stay."""
    whole = F.col("category").isin(*WHOLE_TEXT)
    unique = first_by(items.filter(~whole), ["category", "value"], ORDER, COLUMNS)
    return unique.select(*COLUMNS).unionByName(items.filter(whole).select(*COLUMNS))


def distinct_values(items: DataFrame) -> DataFrame:
    """Just the distinct (category, value) pairs, where provenance is not needed."""
    return items.select("category", "value").distinct()


def at_least(items: DataFrame, confidence: str) -> DataFrame:
    """Items at least as strong as ``confidence``."""
    return items.filter(rank(F.col("confidence")) <= CONFIDENCE_RANK.get(confidence, 99))


def sort_items(items: DataFrame) -> DataFrame:
    """Strongest first within each category, then in the order met."""
    return items.orderBy("category_ord", rank(F.col("confidence")), *[c for c in ORDER if c != "category_ord"])


def stats_per_file(items: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Items per file and category, zero counts included, in one aggregate."""
    names = categories or [c for c in CATEGORIES]
    counts = items.groupBy("path").agg(
        *[F.count_if(F.col("category") == c).alias(f"_{k}") for k, c in enumerate(names)]
    )
    pairs = F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(f"_{k}").alias("n")) for k, c in enumerate(names)
    ])
    return counts.select("path", F.inline(pairs))


def stats(items: DataFrame) -> DataFrame:
    return items.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def totals(items: DataFrame, corpus: DataFrame, *, text: str = "content") -> DataFrame:
    """Files analysed (blank ones are skipped) and items found, as one row."""
    files = corpus.agg(F.count_if(strip(F.col(text)) != "").alias("n"))
    return one_row({"files_analyzed": files, "total_findings": size(items)})


def file_sizes(corpus: DataFrame, *, path: str = "path", text: str = "content") -> DataFrame:
    """Characters per analysed file."""
    docs = corpus.filter(strip(F.col(text)) != "")
    return docs.select(F.col(path).alias("path"), F.length(text).cast("long").alias("file_size"))
