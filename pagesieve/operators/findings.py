"""Static-analysis findings for scripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.catalog.languages import BY_KEY, token
from pagesieve.catalog.vuln_rules import (
    SEVERITY_RANK,
    SNIPPET,
    TAINT_AFTER,
    TAINT_BEFORE,
    TAINT_HINTS,
    WITH_RULE,
    Rule,
    rules,
)
from pagesieve.functions.regex import glob_to_regex, lookup, quoted
from pagesieve.functions.scan import scan, with_fence
from pagesieve.functions.text import UNIVERSAL_LINES, WHITESPACE, basename

COLUMNS = ["rule_id", "severity", "file", "line", "column", "snippet", "rule_ord", "offset"]


def rank(severity: Column) -> Column:
    table = [F.lit(x) for pair in SEVERITY_RANK.items() for x in pair]
    return F.try_element_at(F.create_map(*table), severity)


def has_hint(line: str) -> str:
    """SQL test for any hint of user-controlled data."""
    return "(" + " OR ".join(f"contains({line}, {quoted(h)})" for h in TAINT_HINTS) + ")"


def _is_old(hit: Column, below: tuple[int, int, int]) -> Column:
    """Whether the version in a matched text is lower than ``below``, part by part."""
    rx = r"(\d+)\.(\d+)\.(\d+)$"
    parts = [F.regexp_extract(hit, rx, k).try_cast("long") for k in (1, 2, 3)]
    version = F.struct(*[p.alias(f"v{k}") for k, p in enumerate(parts)])
    limit = F.struct(*[F.lit(b).cast("long").alias(f"v{k}") for k, b in enumerate(below)])
    readable = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return readable & (version < limit)


def findings(
    corpus: DataFrame,
    *,
    path: str = "path",
    text: str = "content",
    groups: list[str] | None = None,
    include_info: bool = True,
    with_statements: bool = False,
    corrected: bool = False,
) -> DataFrame:
    """Every rule match with line, column and snippet; no shuffle.

    Rules are chosen before the scan.  The hint test of the rules that need one
    is prepared once per line, so each match only looks at ten flags.
    """
    chosen = rules(groups, include_info, corrected)
    docs = corpus.select(F.col(path).alias("file"), F.col(text).alias("_text"))
    found = _scan_rules(docs, chosen)
    if with_statements:
        found = found.unionByName(with_findings(corpus, path=path, text=text))
    return found


def surroundings(chosen: list[Rule]) -> dict[str, object]:
    """What ``scan`` needs to add ``snippet`` and, for rules that ask for one, ``hinted``: a hint in the lines around."""
    lines = {"_lines": UNIVERSAL_LINES.format("_text")}
    derive = {"snippet": f"substring(btrim(coalesce(get(_lines, m.line - _b.since), ''), {quoted(WHITESPACE)}), 1, {SNIPPET})"}
    if any(r.taint for r in chosen):
        lines["_hints"] = f"if({has_hint('_text')}, transform(_lines, x -> {has_hint('x')}), array())"
        first = f"greatest(m.line - {TAINT_BEFORE}, 1)"
        derive["hinted"] = f"exists(slice(_hints, {first} - _b.since + 1, m.line + {TAINT_AFTER} - {first} + 1), x -> x)"
    return {"lines": lines, "derive": derive, "margin": (TAINT_BEFORE, TAINT_AFTER)}


def _scan_rules(docs: DataFrame, chosen: list[Rule]) -> DataFrame:
    found = scan(docs, "_text", [r.rx for r in chosen], keep=["file"], **surroundings(chosen))
    for k, r in enumerate(chosen):
        if r.below:
            found = found.filter((F.col("rx") != k) | _is_old(F.col("hit"), r.below))
    needs_hint = [k for k, r in enumerate(chosen) if r.taint]
    if needs_hint:
        found = found.filter(~F.col("rx").isin(needs_hint) | F.col("hinted"))
    order = [r.rule_id for r in rules()] + [WITH_RULE.rule_id]
    attributes = lookup(
        "rx", [{"id": r.rule_id, "severity": r.severity, "ord": order.index(r.rule_id)} for r in chosen]
    )
    return found.withColumn("_r", attributes).select(
        F.col("_r.id").alias("rule_id"), F.col("_r.severity").alias("severity"), "file", "line",
        F.col("col").alias("column"), "snippet", F.col("_r.ord").alias("rule_ord"),
        F.col("off").alias("offset"),
    )


def code_only(text: str) -> Column:
    """SQL column ``text`` with comments and strings blanked, every position kept; needs ``_fence``."""
    js = token(BY_KEY["javascript"])
    pieces = F.expr(f"split(regexp_replace({text}, {quoted(js.jvm())}, concat(_fence, '$0', _fence)), _fence, -1)")
    blanked = F.transform(
        pieces, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, "[^\n]", " ")).otherwise(p)
    )
    return F.array_join(blanked, "")


def with_findings(corpus: DataFrame, *, path: str = "path", text: str = "content") -> DataFrame:
    """``with`` statements, looked for outside comments and strings."""
    has = corpus.filter(F.contains(F.col(text), F.lit("with")))
    docs = with_fence(has.select(F.col(path).alias("file"), F.col(text).alias("_text")), "_text")
    docs = docs.select("file", code_only("_text").alias("_text"))
    found = _scan_rules(docs, [WITH_RULE])
    return found.withColumn("snippet", F.lit("'with' statement"))


def rule_table(spark: SparkSession) -> DataFrame:
    """The rule dimension: one row per rule, a fixed size."""
    rows = [
        (r.rule_id, r.title, r.severity, SEVERITY_RANK[r.severity], r.description, r.remediation, r.cwe, list(r.tags))
        for r in [*rules(), WITH_RULE]
    ]
    schema = (
        "rule_id string, title string, severity string, rank int, description string, "
        "remediation string, cwe string, tags array<string>"
    )
    return spark.createDataFrame(rows, schema)


def enrich(found: DataFrame) -> DataFrame:
    """Attach title, advice, CWE and tags from the fixed rule table."""
    dim = rule_table(found.sparkSession).drop("severity", "rank")
    return found.join(F.broadcast(dim), "rule_id")


def sort_findings(found: DataFrame) -> DataFrame:
    """Most severe first, then by file and line, ties in evaluation order."""
    return found.orderBy(F.desc(rank(F.col("severity"))), "file", "line", "rule_ord", "offset")


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"))


def gate(found: DataFrame) -> DataFrame:
    """One row: 1 when anything HIGH or CRITICAL was found, else 0."""
    bad = F.col("severity").isin("HIGH", "CRITICAL").cast("int")
    return found.agg(F.coalesce(F.max(bad), F.lit(0)).alias("exit_code"))


def exclude_globs(corpus: DataFrame, globs: list[str], *, path: str = "path") -> DataFrame:
    """Drop files whose name matches any glob, before they are scanned."""
    out = corpus
    for g in globs:
        out = out.filter(~basename(F.col(path)).rlike(glob_to_regex(g)))
    return out


def tag_counts(found: DataFrame) -> DataFrame:
    """Findings per tag; counted per rule first, so the tag join sees one row per rule."""
    per_rule = found.groupBy("rule_id").agg(F.count("*").alias("n"))
    tags = rule_table(found.sparkSession).select("rule_id", F.explode("tags").alias("tag"))
    return per_rule.join(F.broadcast(tags), "rule_id").groupBy("tag").agg(F.sum("n").alias("n"))
