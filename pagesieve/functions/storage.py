"""Shared storage for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="pagesieve-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/pagesieve/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def latest_run(spark: SparkSession, folder: str) -> int | None:
    """The greatest number of a finished write among ``folder/run=0``, ``folder/run=1`` ..."""
    if not exists(spark, folder):
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
    runs = sorted((int(n[4:]) for n in names if n.startswith("run=") and n[4:].isdigit()), reverse=True)
    return next((k for k in runs if is_complete(spark, f"{folder}/run={k}")), None)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds the output of a finished write."""
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def materialize(df: DataFrame, path: str, *, resume: bool = False) -> DataFrame:
    """Write ``df`` to ``path`` as Parquet and read it back.

    With ``resume`` a finished earlier write is used as it is.
    """
    spark = df.sparkSession
    if not (resume and is_complete(spark, path)):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
