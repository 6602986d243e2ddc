"""Reports as part files that follow one another."""

import json

from pagesieve.sources import reports as R
from pyspark.sql import functions as F


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_many_parts_are_one_document(spark, tmp_path):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit('"\n\\'), F.col("id"))).alias("v")).repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        R.write_document(df, str(tmp_path / "d"), order=[F.desc("id")], metadata={"n": F.count("*"), "most": F.max("id")}, name="rows")
        R.write_document(df.limit(0), str(tmp_path / "e"), order=["id"])
        R.write_document(df.limit(0), str(tmp_path / "m"), order=["id"], metadata={"n": F.count("*")})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(list((tmp_path / "d").glob("part-*"))) > 3
    whole = json.loads(text_of(tmp_path / "d"))
    assert whole["metadata"] == {"n": 500, "most": 499}
    assert whole["rows"] == [{"id": k, "v": None if k % 3 == 0 else f'"\n\\{k}'} for k in range(499, -1, -1)]
    assert json.loads(text_of(tmp_path / "e")) == []
    assert json.loads(text_of(tmp_path / "m")) == {"metadata": {"n": 0}, "results": []}


def test_headings_stand_above_their_rows(spark, tmp_path):
    rows = [(f"b{k % 9}?{k}", "200", str(k % 2)) for k in range(90)] + [("same?1", "200", "5"), ("same?2", "200", "5")]
    R.write_lines(R.difference_report(spark.createDataFrame(rows, "url string, status string, length string")), str(tmp_path / "r"))
    blocks = text_of(tmp_path / "r").strip("\n").split("\n\n")
    assert [b.split("\n")[0] for b in blocks] == [f"\U0001F525 b{k}" for k in range(9)]
    assert all(b.split("\n")[1:] == sorted(f"b{i}?{k}" for k in range(i, 90, 9)) for i, b in enumerate(blocks))


def test_large_outputs_are_many_files(spark, tmp_path):
    urls = spark.range(300).select(F.concat(F.lit("https://h/api/"), F.col("id"), F.lit(".js?a="), F.col("id")).alias("url"))
    R.write_inventory(urls.unionByName(urls), str(tmp_path / "i"), rows_per_file=50)
    files = {p.name: sorted(p.glob("part-*")) for p in (tmp_path / "i").glob("output=*")}
    assert set(files) == {"output=clean_paths", "output=important_paths", "output=parameters", "output=files_scripts"}
    assert all(len(f.read_text().splitlines()) <= 50 for own in files.values() for f in own) and len(files["output=clean_paths"]) >= 6
    lines = [x for f in files["output=files_scripts"] for x in f.read_text().splitlines()]
    assert lines == sorted(lines) and len(lines) == 300
