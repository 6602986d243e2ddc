"""From raw documents to training sequences, in five stages.

Each stage reads what the one before wrote. The first four return the columns of
``documents``; the last returns pieces of documents placed in sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.functions.storage import materialize, scratch
from pagesieve.llm import decontaminate, language, line_dedup, packing, simhash
from pagesieve.llm.ship import ship
from pagesieve.llm.tokens import public_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the labelled ones teach, go."""
    ship(spark)
    return language.keep_known(docs)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier one go, and so does a document of which nothing else is left."""
    cleaned = line_dedup.dedup_lines(docs)
    nothing_left = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cleaned = cleaned.filter(~F.coalesce(nothing_left, F.lit(False)))
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        cleaned = cleaned.withColumn("n_chars", F.coalesce(size, "n_chars"))
    return cleaned.select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the one with the least ``doc_id`` stays."""
    ship(spark)
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    ship(spark)
    return packing.pack_documents(docs, public_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("line_dedup", distinct_lines),
    ("simhash_near_dedup", distinct_documents),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Language ID and SimHash can't be written in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"{path}/{k}-{name}")
    return docs
