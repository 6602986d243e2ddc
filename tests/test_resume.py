"""Audits that continue, and keys that a stream has met before."""

from conftest import rows

from pagesieve.operators import audit as A
from pagesieve.streaming import streams as ST
from pyspark.sql import functions as F


def corpus(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "path string, content string")


def test_only_changed_documents_are_scanned_again(spark, tmp_path):
    folder = str(tmp_path / "audit")
    texts = {f"d{k}.js": f'fetch("/api/v{k}/x"); eval(a{k}); // note {k}' for k in range(6)}
    A.run(corpus(spark, texts), folder)
    texts["d1.js"] += '\nfetch("/api/new/one");'
    texts["d9.js"] = 'eval("later");'
    del texts["d2.js"]
    again = A.run(corpus(spark, texts), folder)
    assert rows(again) == rows(A.audit(corpus(spark, texts)))
    scanned = spark.read.parquet(f"{folder}/results/run=1").select("source").distinct()
    assert rows(scanned) == [("d1.js",), ("d9.js",)]
    assert rows(A.run(corpus(spark, texts), folder)) == rows(again)
    assert spark.read.parquet(f"{folder}/results/run=2").count() == 0
    assert rows(A.run(corpus(spark, texts), folder, resume=False)) == rows(again)


def test_a_stamp_tells_unchanged_documents(spark, tmp_path):
    folder = str(tmp_path / "audit")
    docs = corpus(spark, {"a.js": "eval(x);", "b.js": "eval(y);"}).withColumn("time", F.lit(1))
    before = rows(A.run(docs, folder, stamp=F.col("time")))
    silent = docs.withColumn("content", F.lit("nothing"))
    assert rows(A.run(silent, folder, stamp=F.col("time"))) == before
    assert A.run(silent.withColumn("time", F.lit(2)), folder, stamp=F.col("time")).count() == 0


def test_a_stream_repeats_no_key(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def feed(*values):
        spark.createDataFrame([(k, c, v) for k, (c, v) in enumerate(values)], "nr int, category string, value string").coalesce(1).write.mode("append").parquet(source)

    def go():
        stream = spark.readStream.schema("nr int, category string, value string").parquet(source)
        ST.write_first_seen(stream, out, checkpoint, keys=["category", "value"], order=["nr"], through=F.col("category") == "note").awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).select("category", "value").collect())

    feed(("a", "x"), ("a", "x"), ("b", "x"), ("note", "n"), ("note", "n"))
    assert go() == [("a", "x"), ("b", "x"), ("note", "n"), ("note", "n")]
    feed(*[("a", "x")] * 500, ("a", "y"), ("note", "n"))
    want = [("a", "x"), ("a", "y"), ("b", "x"), ("note", "n"), ("note", "n"), ("note", "n")]
    assert go() == want and go() == want
    # the last batch runs again as if its end had never been noted
    last = max((tmp_path / "cp" / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink()
    assert go() == want
