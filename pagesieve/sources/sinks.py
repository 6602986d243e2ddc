"""Writers for results: JSON lines, CSV, report lines, one folder per language or category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.catalog.vuln_rules import SEVERITY_RANK
from pagesieve.operators.findings import enrich, sort_findings
from pagesieve.operators.comments import language_slug


def write_json(df: DataFrame, path: str, *, total: str = "total", tool: str = "pagesieve") -> None:
    """Rows as JSON lines under ``path/rows`` and one metadata record under ``path/metadata``."""
    df.write.mode("overwrite").json(f"{path}/rows")
    rows = df.sparkSession.read.schema(df.schema).json(f"{path}/rows")
    meta = rows.agg(F.count("*").alias(total)).select(
        F.lit(tool).alias("tool"), F.current_timestamp().alias("timestamp"), total
    )
    meta.write.mode("overwrite").json(f"{path}/metadata")


def item_table(items: DataFrame) -> DataFrame:
    """Items under the column titles of the CSV report."""
    return items.select(
        F.col("category").alias("Category"), F.col("value").alias("Value"),
        F.col("confidence").alias("Confidence"), F.col("line_number").alias("Line Number"),
        F.col("path").alias("Source File"),
    )


def write_csv(items: DataFrame, path: str) -> None:
    item_table(items).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def finding_block() -> Column:
    """The lines that report an enriched finding."""
    tags = F.coalesce(F.nullif(F.array_join("tags", ", "), F.lit("")), F.lit("-"))
    parts = [
        F.format_string("[%s] %s  %s", "severity", "rule_id", "title"),
        F.format_string("   File : %s:%d:%d", "file", "line", "column"),
        F.format_string("   CWE  : %s    Tags: %s", "cwe", tags),
        F.when(F.col("snippet") != "", F.concat(F.lit("   Code : "), "snippet")),
        F.concat(F.lit("   Fix  : "), "remediation"),
    ]
    return F.concat_ws("\n", *parts)


def finding_lines(found: DataFrame) -> DataFrame:
    """Report block of each finding, most severe first."""
    return sort_findings(enrich(found)).select(finding_block().alias("block"))


def severity_line(counts: DataFrame) -> DataFrame:
    """``CRITICAL=1, HIGH=2`` for the severities present; at most one entry per severity."""
    pairs = [F.max(F.when(F.col("severity") == s, F.concat(F.lit(f"{s}="), F.col("n").cast("string")))) for s in SEVERITY_RANK]
    return counts.agg(F.concat_ws(", ", *pairs).alias("line"))


def endpoint_lines(found: DataFrame) -> DataFrame:
    """``[METHOD] url (file:line)`` per endpoint."""
    method = F.when(F.col("method").isNotNull(), F.concat(F.lit("["), "method", F.lit("] "))).otherwise("")
    place = F.format_string("  (%s:%d)", "source_file", "line_number")
    return found.select(F.concat(method, "url", place).alias("line"))


def item_lines(items: DataFrame) -> DataFrame:
    """Markdown bullet per item."""
    return items.select(
        F.format_string("- `%s` (Line %d, %s)", "value", "line_number", "confidence").alias("line")
    )


def comment_tag(start: Column, end: Column, kind: Column) -> Column:
    """``[LINE  L3]`` or ``[BLOCK L3-L5]``."""
    span = F.concat(F.lit("L"), start.cast("string"), F.when(end != start, F.concat(F.lit("-L"), end.cast("string"))).otherwise(""))
    return F.concat(F.lit("["), F.when(kind == "line", "LINE ").otherwise("BLOCK"), F.lit(" "), span, F.lit("]"))


def comment_lines(found: DataFrame) -> DataFrame:
    tag = comment_tag(F.col("line_start"), F.col("line_end"), F.col("type"))
    return found.select(F.concat(F.lit("  "), tag, F.lit(" "), "text").alias("line"))


def write_by_language(found: DataFrame, path: str) -> None:
    """Comments in one folder per language."""
    rows = found.withColumn("lang_slug", language_slug(F.col("language")))
    rows.write.mode("overwrite").partitionBy("lang_slug").json(path)


def write_by_category(urls: DataFrame, path: str) -> None:
    """URLs in one folder per category."""
    urls.select("category", "url").write.mode("overwrite").partitionBy("category").text(path)
