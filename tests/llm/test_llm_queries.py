"""The registered queries beside SQL, and the pipeline beside its parts."""

import duckdb
import pytest
from conftest import FOLDER, rows

import corpus_pipeline
from pagesieve.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("pages", "documents", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    want = db.sql(ORACLE[name]).select(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert rows(df, *cols) == sorted(want, key=repr)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns
        assert docs.count() <= n, name
        n = docs.count()
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids)) > 100
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.collect()} == set(ids)
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == set(ids)
