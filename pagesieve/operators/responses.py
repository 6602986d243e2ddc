"""Stored HTTP responses: differences, status triage, hosts and ports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.skew import SALTS, salted_join

# Default status lists.
DEFAULT_OK = [200, 301, 302, 400, 401, 403, 500]
BUCKETS = [401, 403, 500, 501, 505, 200, 301, 302, 307, 204]


def differences(responses: DataFrame, salts: int = SALTS) -> DataFrame:
    """Base URLs whose responses differ in status or length, with all their URLs.

    A base differs when the least and the greatest of its values differ, which an
    aggregate keeps in two fields however many responses a base has.  URLs are
    reduced to distinct pairs and joined back in salted slices, one row per URL.
    """
    value = F.concat_ws("_", "status", "length")
    rows = responses.select(F.substring_index("url", "?", 1).alias("base_url"), "url", value.alias("v"))
    changed = (
        rows.groupBy("base_url").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        .filter(F.col("lo") != F.col("hi")).select("base_url")
    )
    pairs = rows.select("base_url", "url").distinct()
    # inner rather than semi: a semi join would be pushed below the distinct, onto all responses
    return salted_join(pairs, changed, "base_url", ["url"], "inner", salts).select("base_url", "url")


def online(urls: DataFrame, responses: DataFrame, status: str = "200") -> DataFrame:
    """URLs with a response of ``status``; both sides are reduced to distinct URLs first."""
    live = responses.filter(F.col("status") == status).select("url").distinct()
    return urls.select("url").distinct().join(live, "url", "left_semi")


def normalize_target(target: Column) -> Column:
    """Default to http and drop closing slashes; null when there is nothing."""
    full = F.when(F.contains(target, F.lit("://")), target).otherwise(F.concat(F.lit("http://"), target))
    return F.when(target != "", F.rtrim(full, F.lit("/")))


def host_ports(hosts: DataFrame, ports: list[str], *, host: str = "host") -> DataFrame:
    """``host:port`` for every host and port of the given list."""
    kept = [p.strip() for p in ports if p.strip()]
    site = hosts.select(normalize_target(F.col(host)).alias("_h")).filter(F.coalesce(F.col("_h"), F.lit("")) != "")
    each = site.select("_h", F.explode(F.array(*[F.lit(p) for p in kept])).alias("_p"))
    return each.select(F.concat_ws(":", "_h", "_p").alias("url"))


def parse_status_codes(codes: str | list[int] | None) -> list[int]:
    """Status list from a comma- or space-separated setting."""
    if codes is None:
        return list(DEFAULT_OK)
    parts = codes.replace(" ", ",").split(",") if isinstance(codes, str) else codes
    return [int(p) for p in parts if str(p).strip()]


def with_ok(results: DataFrame, codes: str | list[int] | None = None) -> DataFrame:
    """Add ``ok``: the status is on the list; a missing status is not."""
    return results.withColumn("ok", F.coalesce(F.col("status_code").isin(parse_status_codes(codes)), F.lit(False)))


def ok_lines(results: DataFrame) -> DataFrame:
    """Report lines of the OK results, by URL."""
    kept = results.filter("ok").orderBy("url", "status_code")
    return kept.select(F.concat(F.col("status_code").cast("string"), F.lit(" : "), "url").alias("line"))


def status_buckets(responses: DataFrame, extra: list[int] | None = None, *, substring_mode: bool = False) -> DataFrame:
    """Responses per listed status.  ``substring_mode`` looks for the digits anywhere in the line."""
    codes = [str(c) for c in [*BUCKETS, *(extra or [])]]
    if not substring_mode:
        kept = responses.filter(F.col("status").isin(codes))
        return kept.select(F.col("status").alias("bucket"), "url", "status", "length")
    line = F.concat_ws(" ", "url", "status", "length")
    tests = [F.when(F.contains(line, F.lit(c)), F.lit(c)) for c in dict.fromkeys(codes)]
    found = responses.select(F.explode_outer(F.array(*tests)).alias("bucket"), "url", "status", "length")
    return found.filter(F.col("bucket").isNotNull())
