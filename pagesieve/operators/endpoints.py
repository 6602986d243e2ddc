"""Endpoints mentioned in scripts: where, of which kind, with which method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.catalog.endpoint_types import (
    CONTEXT_WINDOW,
    ENDPOINT_TYPES,
    METHOD,
    METHOD_WINDOW,
    REJECT_AT_START,
    STATIC_ASSET,
)
from pagesieve.functions.regex import Rx, lookup
from pagesieve.functions.scan import scan
from pagesieve.functions.text import strip
from pagesieve.functions.url import with_normalized

COLUMNS = [
    "source_file", "url", "line_number", "context", "method", "endpoint_type", "pattern_ord", "offset",
]
_METHOD = f"(?diU){METHOD}"


def is_endpoint(value: Column, drop_static_assets: bool = False) -> Column:
    """Whether ``value`` can be an endpoint: long enough, not rejected, holds a slash."""
    v = strip(value)
    # every alternative is tried at the start of the value only
    rejected = v.rlike("(?dU)^(?:" + "|".join(f"(?:{p})" for p in REJECT_AT_START) + ")")
    pathlike = F.contains(v, F.lit("/")) | F.startswith(v, F.lit("http")) | F.startswith(v, F.lit("ws"))
    ok = (F.length(v) >= 2) & pathlike & ~rejected
    return ok & ~v.rlike(STATIC_ASSET) if drop_static_assets else ok


def method_before(text: Column) -> Column:
    """HTTP method named last-but-first in the text ahead of an endpoint, or null."""
    named = F.nullif(F.regexp_extract(text, _METHOD, 1), F.lit(""))
    called = F.nullif(F.regexp_extract(text, _METHOD, 3), F.lit(""))
    return F.upper(F.coalesce(named, called))


def endpoints(
    corpus: DataFrame,
    *,
    path: str = "path",
    text: str = "content",
    types: list[str] | None = None,
    drop_static_assets: bool = False,
    context: bool = True,
    method: bool = True,
) -> DataFrame:
    """Every endpoint in every document, in long form.

    A projection and one generate per document: no shuffle.  ``types`` limits the
    search before anything is scanned, and context or method are only worked out
    when asked for.
    """
    chosen: list[tuple[int, str, Rx]] = [
        (k, name, rx) for k, (name, rx) in enumerate(ENDPOINT_TYPES) if types is None or name in types
    ]
    docs = corpus.select(F.col(path).alias("source_file"), F.col(text).alias("_text"))
    found = scan(
        docs, "_text", [rx for _, _, rx in chosen], keep=["source_file"],
        before=METHOD_WINDOW if method else CONTEXT_WINDOW if context else 0,
        after=CONTEXT_WINDOW if context else 0,
    ).filter(is_endpoint(F.col("value"), drop_static_assets))
    found = with_normalized(found, "value", "source_file", "url")
    found = found.filter(is_endpoint(F.col("url"), drop_static_assets))
    found = found.withColumn("_type", lookup("rx", [{"name": name, "ord": k} for k, name, _ in chosen]))
    around = F.concat(F.substring("before", -CONTEXT_WINDOW, CONTEXT_WINDOW), "hit", "after")
    return found.select(
        "source_file",
        "url",
        F.col("line").alias("line_number"),
        (F.replace(around, F.lit("\n"), F.lit(" ")) if context else F.lit(None).cast("string")).alias("context"),
        (method_before(F.col("before")) if method else F.lit(None).cast("string")).alias("method"),
        F.col("_type.name").alias("endpoint_type"),
        F.col("_type.ord").alias("pattern_ord"),
        F.col("off").alias("offset"),
    )


def first_by(df: DataFrame, keys: list[str], order: list[str], rest: list[str]) -> DataFrame:
    """One row per key: the first by ``order``.

    An aggregate instead of a window, so every task reduces its rows to one per
    key before the shuffle and a key that holds much of the data stays cheap.
    """
    packed = F.struct(*order, *[c for c in rest if c not in order])
    best = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return best.select(*[f"_first.{c}" for c in dict.fromkeys([*order, *rest])], *[k for k in keys if k not in order + rest])


def dedup_endpoints(found: DataFrame) -> DataFrame:
    """First endpoint per URL without its query, in (file, detector, position) order."""
    keyed = found.withColumn("_key", F.substring_index("url", "?", 1))
    order = ["source_file", "pattern_ord", "offset"]
    return first_by(keyed, ["_key"], order, COLUMNS).select(*COLUMNS)


def filter_endpoints(found: DataFrame, pattern: str) -> DataFrame:
    """Endpoints whose URL matches ``pattern``, ignoring case."""
    return found.filter(F.col("url").rlike(f"(?diU){pattern}"))


def count_by_type(found: DataFrame) -> DataFrame:
    return found.groupBy("endpoint_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "endpoint_type")


def count_by_method(found: DataFrame) -> DataFrame:
    method = F.coalesce("method", F.lit("Unknown")).alias("method")
    return found.groupBy(method).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "method")


def count_by_file(found: DataFrame) -> DataFrame:
    return found.groupBy("source_file").agg(F.count("*").alias("n"))
