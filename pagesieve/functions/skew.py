"""Joins on keys of which one may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    big: DataFrame, keyed: DataFrame, key: str, spread: list[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join ``big`` with ``keyed`` (one row per ``key``) on ``key``.

    Rows of ``big`` with the same key go to ``salts`` tasks according to the
    ``spread`` columns; each row of ``keyed`` is repeated once per salt.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
