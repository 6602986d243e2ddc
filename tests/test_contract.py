"""Queries beside their SQL counterparts, and the streams."""

import duckdb
import pytest
from conftest import FOLDER, rows

import __spark_entry__ as entry
from pagesieve.streaming import streams as ST

TABLES = ["pages", "documents", "events", "customer"]
SAMPLE = [
    "endpoints_all", "ep_dedup", "js_items_all", "js_dedup", "vuln_findings", "comments_all", "html_links",
    "html_script_src", "url_summary", "response_diff", "link_reach", "audit_rollup", "url_normalize",
    "stream_endpoints", "stream_first_seen", "sink_csv_roundtrip", "report_findings", "report_comments", "report_differences",
    "sink_json_document", "sink_json_array", "sink_inventory", "scan_corpus", "decode_text",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_counterpart_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["endpoint_type", "n"]


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    want = db.sql(entry.oracle_sql()[name]).select(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert rows(df, *[f"`{c}`" for c in cols]) == sorted(want, key=repr)


def test_windowed_counts_drop_late_rows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, severity string"

    def feed(*times):
        spark.createDataFrame([(t, "HIGH") for t in times], "t string, severity string").selectExpr(
            "CAST(t AS timestamp) AS ts", "severity").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        counts = ST.windowed_counts(stream, time="ts", by="severity")
        ST.write_stream(counts, out, str(tmp_path / "cp")).awaitTermination()

    feed("2024-01-01 00:10:00", "2024-01-01 00:20:00")
    feed("2024-01-01 05:00:00")
    feed("2024-01-01 00:30:00", "2024-01-01 09:00:00")
    got = spark.read.parquet(out).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.n) for r in got] == [(0, 2), (5, 1)]
