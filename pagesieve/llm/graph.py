"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.storage import materialize, scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge.

    ``edges`` has two columns of one type; direction, order, repeats and loops don't
    matter. Each round lets all larger neighbours of a node, then all smaller ones, point at
    the least of them (large star and small star); a number of rounds near the logarithm of
    the longest path suffices. A round is written to the shared folder, so a lost executor costs
    at most a part of one round. Minima are reduced before each shuffle; the joins are plain
    equi-joins, of which adaptive execution splits the partition of a hub.
    """
    spark, path = edges.sparkSession, scratch(edges.sparkSession, "components")
    a, b = edges.columns
    ends = F.array(a, b)
    now = edges.filter(F.col(a) != F.col(b)).select(F.array_max(ends).alias("u"), F.array_min(ends).alias("v")).distinct()
    now, seen, k = materialize(now, f"{path}/0"), None, 0
    while (state := _digest(now)) != seen:
        seen, k = state, k + 1
        now = materialize(_small_star(_large_star(now)), f"{path}/{k}")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
