"""Inventory of URLs: scope, paths, categories, parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.text import strip
from pagesieve.functions.url import clean_path, netloc

# What makes a path interesting, and URL categories by extension.
IMPORTANT_PATH = (
    r"/(api|admin|login|dashboard|v[0-9]|graphql|swagger|wp-json|auth|config|internal|db|test|dev)(\/|$)"
)
URL_CATEGORIES = {
    "configs": r"\.(json|xml|yml|yaml|env|config|conf|ini|properties|log|txt|md)(\?|$|#)",
    "scripts": r"\.(js|js\.map|map|svg)(\?|$|#)",
    "web_pages": r"\.(html|css|asp|php|aspx|jsp|cgi|cfm|do|action)(\?|$|#)",
    "backups": r"\.(git|env|bak|old|zip|tar|gz|sql)(\?|$|#)",
}
# A domain name, and the names of a query.
DOMAIN_NAME = r"^[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$"
QUERY_NAME = r"(?:^|&)([a-zA-Z0-9_\-]+)="
SCOPE_CHUNK = 200


def inventory(*feeds: DataFrame, url: str = "url") -> DataFrame:
    """Distinct trimmed URLs of all feeds, blanks left out."""
    out = feeds[0].select(strip(F.col(url)).alias("url"))
    for f in feeds[1:]:
        out = out.unionByName(f.select(strip(F.col(url)).alias("url")))
    return out.filter(F.col("url") != "").distinct()


def on_domain(urls: DataFrame, domain: str) -> DataFrame:
    """URLs that mention ``domain`` or a host under it."""
    return urls.filter(F.col("url").rlike(rf"(?idU)([a-zA-Z0-9_-]+\.)*{re.escape(domain)}\b"))


def is_domain_name(c: Column) -> Column:
    return c.rlike(DOMAIN_NAME)


def scope_patterns(lines: list[str]) -> list[str]:
    """Scope lines without blanks and remarks."""
    kept = [line.strip() for line in lines]
    return [line for line in kept if line and not line.startswith("#")]


def is_in_scope(url: Column, scope: list[str]) -> Column:
    """Whether the authority of ``url`` (or the value itself) fits any pattern; ``*`` fits all.

    The pattern list is a setting; it becomes a few literal alternations, so the
    test is a filter on the scan and needs no join.
    """
    site = F.coalesce(F.nullif(netloc(url), F.lit("")), url)
    patterns = [re.escape(p).replace(r"\*", ".*") for p in scope_patterns(scope)]
    hit = F.lit(False)
    for k in range(0, len(patterns), SCOPE_CHUNK):
        hit = hit | site.rlike("(?diU)^(?:" + "|".join(patterns[k : k + SCOPE_CHUNK]) + ")$")
    return hit


def in_scope(urls: DataFrame, scope: list[str]) -> DataFrame:
    return urls.filter(is_in_scope(F.col("url"), scope))


def scope_dropped(urls: DataFrame, scope: list[str]) -> DataFrame:
    return urls.select("url").distinct().agg(F.count_if(~is_in_scope(F.col("url"), scope)).alias("out_of_scope_dropped"))


def clean_paths(urls: DataFrame) -> DataFrame:
    return urls.select(clean_path(F.col("url")).alias("path")).distinct()


def important_paths(urls: DataFrame) -> DataFrame:
    return urls.select(clean_path(F.col("url")).alias("path")).filter(is_important(F.col("path"))).distinct()


def is_important(path: Column) -> Column:
    return path.rlike(f"(?idU){IMPORTANT_PATH}")


def categories(urls: DataFrame) -> DataFrame:
    """(category, url) for each category a URL falls in; it may be several."""
    tests = [F.when(F.col("url").rlike(f"(?idU){rx}"), F.lit(c)) for c, rx in URL_CATEGORIES.items()]
    found = urls.select("url", F.explode_outer(F.array(*tests)).alias("category"))
    return found.filter(F.col("category").isNotNull()).select("category", "url")


def parameters_of(url: Column) -> Column:
    return F.regexp_extract_all(F.get(F.split(url, r"\?"), F.lit(1)), F.lit(QUERY_NAME), F.lit(1))


def parameter_names(urls: DataFrame) -> DataFrame:
    """Distinct parameter names, read from the part after the first ``?`` only."""
    found = urls.select(F.explode_outer(parameters_of(F.col("url"))).alias("parameter"))
    return found.filter(F.col("parameter").isNotNull()).distinct()


def summary(urls: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """One row of counts over the distinct URLs, those in scope if a scope is given.

    The URLs are made distinct once; what is counted of each becomes rows of (kind, value), which
    are made distinct and counted together.
    """
    inside = is_in_scope(F.col("url"), scope) if scope is not None else F.lit(True)
    path = clean_path(F.col("url"))
    known = urls.select("url").distinct().select("url", inside.alias("_in"), path.alias("_path"), parameters_of(F.col("url")).alias("_names"))
    kinds = F.when(~F.col("_in"), F.array(F.struct(F.lit("out_of_scope_dropped").alias("kind"), F.col("url").alias("value")))).otherwise(F.concat(
        F.array(F.struct(F.lit("total_urls").alias("kind"), F.col("url").alias("value")), F.struct(F.lit("clean_paths").alias("kind"), F.col("_path").alias("value"))),
        F.transform(F.coalesce("_names", F.array().cast("array<string>")), lambda n: F.struct(F.lit("unique_parameters").alias("kind"), n.alias("value"))),
    ))
    counted = known.select(F.inline(kinds)).distinct()
    important = (F.col("kind") == "clean_paths") & is_important(F.col("value"))
    names = ["total_urls", "clean_paths", "important_paths", "unique_parameters", "out_of_scope_dropped"]
    return counted.agg(*[F.count_if(important if n == "important_paths" else F.col("kind") == n).alias(n) for n in names])


def substitute_parameters(urls: DataFrame, marker: str) -> DataFrame:
    """Distinct URLs with every parameter value replaced by ``marker``."""
    base = F.substring_index("url", "?", 1)
    whole = F.substring(F.col("url"), F.length(base) + 1, F.length("url"))
    query = F.substring_index(whole, "#", 1)
    fragment = F.substring(whole, F.length(query) + 1, F.length(whole))
    replaced = F.concat(base, F.regexp_replace(query, r"=[^&]*", "=" + marker), fragment)
    return urls.filter(F.contains(F.col("url"), F.lit("?"))).select(replaced.alias("url")).distinct()


def scripts_only(urls: DataFrame) -> DataFrame:
    """URLs that mention ``.js``, in any case."""
    return urls.filter(F.contains(F.lower("url"), F.lit(".js")))
