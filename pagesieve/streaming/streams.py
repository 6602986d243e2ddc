"""The operators over a stream of documents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagesieve.functions.storage import exists, materialize
from pagesieve.operators.endpoints import first_by

#: Folders over which the digests of a batch's keys are dealt.
KEY_BUCKETS = 16


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files of ``path`` as they arrive; the table may be one file or a folder."""
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema)
    is_file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if is_file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(is_file).isFile():
        return stream.option("pathGlobFilter", _literal(name)).parquet(_literal(folder))
    return stream.parquet(_literal(path))


def _literal(path: str) -> str:
    """``path`` for readers that take it as a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def write_stream(df: DataFrame, out: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Write everything available and stop; the checkpoint makes a restart continue."""
    return (
        df.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def extract(stream: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A document-local operator over a stream; it keeps no state."""
    return operator(stream)


def with_time(stream: DataFrame, time: str, operator: Callable[[DataFrame], DataFrame], path: str, out: str | None = None) -> DataFrame:
    """A document-local operator over a stream, its rows with the time of their document.

    The time travels in the path, as operators keep only that of a document's columns.
    """
    out = out or path
    micros = F.unix_micros(time).cast("string")
    tagged = stream.withColumn(path, F.concat(micros, F.lit("\x00"), path)).drop(time)
    found = operator(tagged)
    moment = F.timestamp_micros(F.substring_index(out, "\x00", 1).cast("long"))
    return found.withColumn(time, moment).withColumn(out, F.regexp_replace(out, "^[0-9-]+\\x00", ""))


def first_seen(items: DataFrame, *, time: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """One row per key within the watermark delay; older keys leave the state.

    The state holds the keys of one delay. A stream has no reduction before its shuffle, so rows of one
    key in one batch meet in one task, which keeps none of them but the first.
    """
    return items.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def write_first_seen(
    items: DataFrame, out: str, checkpoint: str, *, keys: list[str], order: list[str], through: Column | None = None
) -> StreamingQuery:
    """Write each key of a stream once, however long it runs: the first row by ``order`` of the batch that has it first.

    A batch is reduced to one row a key before its shuffle, so a key in very many rows is no task's burden, and
    loses the keys of earlier batches by an anti-join with their digests. Those lie under the checkpoint, one folder
    for each batch and bucket. A batch that is run again, after a failure or a restart, replaces its own output and digests and looks
    at earlier ones only, so nothing is repeated or lost. Rows for which ``through`` holds are all written.
    """
    columns = items.columns
    known = f"{checkpoint}/keys"
    digest = F.unhex(F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})))

    def step(batch: DataFrame, nr: int) -> None:
        spark = batch.sparkSession
        passing = F.coalesce(through, F.lit(False)) if through is not None else F.lit(False)
        best = first_by(batch.filter(~passing), keys, order, columns).select(*columns)
        best = best.withColumn("_digest", digest).withColumn("_bucket", F.pmod(F.xxhash64("_digest"), F.lit(KEY_BUCKETS)).cast("int"))
        if nr and exists(spark, known):
            earlier = spark.read.schema("_digest binary, batch long, _bucket int").parquet(known).filter(F.col("batch") < nr)
            best = best.join(earlier.select("_bucket", "_digest"), ["_bucket", "_digest"], "left_anti")
        new = materialize(best, f"{checkpoint}/new/batch={nr}")
        new.select("_digest", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{known}/batch={nr}")
        rows = new.select(*columns).unionByName(batch.filter(passing))
        rows.write.mode("overwrite").parquet(f"{out}/batch={nr}")

    return items.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/progress").trigger(availableNow=True).start()


def windowed_counts(found: DataFrame, *, time: str, by: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows per time window and ``by``; rows later than the delay are dropped."""
    counts = found.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), by)
    return counts.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
