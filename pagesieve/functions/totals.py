"""Several counts as one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(counts: dict[str, DataFrame]) -> DataFrame:
    """Put single-row, single-column results side by side.

    They are stacked under their names and folded by one aggregate, so no join is
    involved.
    """
    stacked = [df.select(F.lit(name).alias("_name"), F.col(df.columns[0]).alias("_n")) for name, df in counts.items()]
    total = reduce(DataFrame.unionByName, stacked)
    return total.agg(*[F.max(F.when(F.col("_name") == name, F.col("_n"))).alias(name) for name in counts])


def size(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))
