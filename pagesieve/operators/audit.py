"""Everything found in a corpus, in one long table."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.catalog.endpoint_types import ENDPOINT_TYPES
from pagesieve.catalog.js_categories import CATEGORIES, detectors
from pagesieve.catalog.languages import LANGUAGES, token
from pagesieve.catalog.vuln_rules import rules
from pagesieve.functions.storage import latest_run, materialize
from pagesieve.operators import comments as _comments
from pagesieve.operators import endpoints as _endpoints
from pagesieve.operators import findings as _findings
from pagesieve.operators import items as _items
from pagesieve.operators import responses as _responses
from pagesieve.operators import scripts as _scripts
from pagesieve.operators import urls as _urls

COLUMNS = ["source", "kind", "category", "severity", "value", "line"]
KINDS = ["endpoint", "item", "finding", "comment"]


def family(corpus: DataFrame, kind: str) -> DataFrame:
    """One family of results over ``corpus(path, content)`` in the shared shape."""
    none = F.lit(None).cast("string")
    if kind == "endpoint":
        found = _endpoints.endpoints(corpus, context=False, method=False)
        cols = [F.col("source_file"), F.col("endpoint_type"), none, F.col("url"), F.col("line_number")]
    elif kind == "item":
        found = _items.js_items(corpus)
        cols = [F.col("path"), F.col("category"), F.col("confidence"), F.col("value"), F.col("line_number")]
    elif kind == "finding":
        found = _findings.findings(corpus)
        cols = [F.col("file"), F.col("rule_id"), F.col("severity"), F.col("snippet"), F.col("line")]
    else:
        found = _comments.comments(corpus)
        cols = [F.col("path"), F.col("type"), none, F.col("text"), F.col("line_start")]
    source, category, severity, value, line = cols
    return found.select(
        source.alias("source"), F.lit(kind).alias("kind"), category.alias("category"),
        severity.alias("severity"), value.alias("value"), line.alias("line"),
    )


def audit(corpus: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """All families over readable documents; each reads the corpus for itself, and nothing is shuffled."""
    kept = _scripts.readable(corpus)
    return reduce(DataFrame.unionByName, [family(kept, k) for k in kinds or KINDS])


def audit_crawl(urls: DataFrame, responses: DataFrame, bodies: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The whole chain: script URLs that answered 200, their stored bodies, then every family.

    ``bodies(path, content)`` holds one row per URL.
    """
    live = _responses.online(_urls.scripts_only(urls), responses)
    corpus = bodies.join(live.select(F.col("url").alias("path")), "path", "left_semi")
    return audit(corpus, kinds)


def new_scripts(found: DataFrame, known: DataFrame) -> DataFrame:
    """Script URLs met among the endpoints that the inventory lacks: the next round's input."""
    met = found.filter(F.col("kind") == "endpoint").select(F.col("value").alias("url"))
    return _urls.scripts_only(met).distinct().join(known.select("url").distinct(), "url", "left_anti")


def rollup(found: DataFrame) -> DataFrame:
    """Counts by source, kind and category with all subtotals; null marks a total.

    Rows are counted at the finest level first, so the expansion into subtotals
    works on one row per combination.
    """
    fine = found.groupBy("source", "kind", "category").agg(F.count("*").alias("_n"))
    return fine.rollup("source", "kind", "category").agg(
        F.sum("_n").alias("n"), F.grouping_id().cast("int").alias("level")
    )


def _settings() -> str:
    """A digest of all that decides what is found in a text."""
    parts = [
        [(n, rx) for n, rx in ENDPOINT_TYPES], [(c, detectors(c)) for c in CATEGORIES], [(r.rule_id, r.rx, r.severity) for r in rules()],
        [token(lang) for lang in LANGUAGES],
    ]
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def run(corpus: DataFrame, folder: str, *, resume: bool = True, stamp: Column | None = None) -> DataFrame:
    """Audit what is new or changed since the last run under ``folder`` and combine it with what that run knows.

    ``folder/manifest`` holds, for each finished run, every document with its stamp and the run that scanned it;
    ``folder/results`` holds what each run found. A document is scanned again when its stamp or any expression has changed;
    documents that are gone drop out of the result. ``stamp`` is what tells a change, such as a file's time and size, from which
    unchanged documents are known without their text; by default a hash of the text. ``path`` is the key of the corpus.
    A run that failed leaves no manifest and counts for nothing.
    """
    spark = corpus.sparkSession
    seen = F.sha2(F.concat_ws("|", F.lit(_settings()), (stamp if stamp is not None else F.sha2("content", 256)).cast("string")), 256)
    stamped = corpus.withColumn("_stamp", seen)
    last = latest_run(spark, f"{folder}/manifest") if resume else None
    if last is None:
        last, known = latest_run(spark, f"{folder}/manifest"), None
    else:
        known = spark.read.schema("path string, _stamp string, run int").parquet(f"{folder}/manifest/run={last}")
    now = 0 if last is None else last + 1
    docs = stamped.select("path", "_stamp").distinct()
    if known is None:
        manifest, todo = docs.withColumn("run", F.lit(now)), stamped
    else:
        kept = docs.join(known, ["path", "_stamp"], "left")
        manifest = kept.select("path", "_stamp", F.coalesce("run", F.lit(now)).alias("run"))
        todo = stamped.join(known.select("path", "_stamp"), ["path", "_stamp"], "left_anti")
    materialize(audit(todo.drop("_stamp")), f"{folder}/results/run={now}")
    manifest = materialize(manifest, f"{folder}/manifest/run={now}")
    schema = "source string, kind string, category string, severity string, value string, line int, run int"
    found = spark.read.schema(schema).parquet(f"{folder}/results")
    return found.join(manifest.select(F.col("path").alias("source"), "run").distinct(), ["source", "run"], "left_semi").select(*COLUMNS)
