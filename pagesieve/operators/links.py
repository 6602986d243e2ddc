"""Depth-bounded traversal of a link graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.skew import SALTS
from pagesieve.functions.storage import cut_lineage


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 1, salts: int = SALTS) -> DataFrame:
    """Nodes reached from ``seeds`` along ``edges(src, dst)``, with their least depth.

    Breadth first: each round joins the new nodes with the edges and drops nodes
    met before.  Edges are deduplicated and laid out once by source and a salt of
    the target, so a hub that holds much of the graph is read by many tasks.
    Every round ends in a reliable checkpoint; the loop stops when nothing is new.
    """
    salt = F.pmod(F.xxhash64("dst"), F.lit(salts)).cast("int")
    graph = edges.select("src", "dst").distinct().filter(F.col("src") != F.col("dst"))
    graph = cut_lineage(graph.withColumn("_salt", salt).repartition("src", "_salt"))
    frontier = cut_lineage(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    levels = [frontier]
    for level in range(1, depth + 1):
        spread = frontier.select(
            F.col("node").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
        )
        met = graph.join(spread, ["src", "_salt"], "left_semi").select(F.col("dst").alias("node")).distinct()
        visited = reduce(DataFrame.unionByName, levels).select("node")
        frontier = cut_lineage(met.join(visited, "node", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels)


def page_edges(internal_links: DataFrame) -> DataFrame:
    """Edges between pages from ``html.internal(html.links(...))``."""
    return internal_links.select(F.col("page_url").alias("src"), F.col("link_url").alias("dst"))


def reached_scripts(reached: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct external scripts of the reached pages; both joins are on unique nodes."""
    pages = reached.select(F.col("node").alias("page_url")).distinct()
    return sources.join(pages, "page_url", "left_semi").select("script_url").distinct()
