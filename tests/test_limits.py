"""Long lines, unread files, source maps, restarts of streams by folder."""

import random
import re
import time

import pytest
from conftest import rows

from pagesieve.catalog.js_categories import CATEGORIES, detectors
from pagesieve.catalog.vuln_rules import rules
from pagesieve.functions.scan import extract_values, scan
from pagesieve.operators import urls as U
from pagesieve.sources import corpus as SRC
from pagesieve.streaming import streams as ST

IDLE_RULES = [r for r in rules() if r.rx.idle]
IDLE_ITEMS = [rx for c in CATEGORIES for rx, _ in detectors(c) if rx.idle]
WORDS = ["$(", ").html(", "sax", " parse", "exec(", "child_process.", "fs.stat(", "require(", "require", "(", ")", "+", "'x'", " ", "\n", "a", "body:{", "}", "{", "x"]


def test_idle_stretches_change_nothing(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(WORDS) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8)
    found = scan(df, "text", [r.rx for r in IDLE_RULES], keep=["id"])
    want = []
    for k, r in enumerate(IDLE_RULES):
        for i, t in enumerate(texts):
            want += [(i, k, m.start(), m.group()) for m in re.finditer(r.rx.pattern, t)]
    assert not set(rows(found, "id", "rx", "off", "hit")) ^ set(want)
    lines = [(i, x) for i, t in enumerate(texts) for x in t.split("\n")]
    got = extract_values(spark.createDataFrame(lines, "id int, text string").repartition(8), "text", IDLE_ITEMS, keep=["id"])
    want = [(i, k, m.group(1)) for i, x in lines for k, rx in enumerate(IDLE_ITEMS) for m in re.finditer(rx.pattern, x)]
    assert rows(got, "id", "rx", "value") == sorted(want, key=repr)


@pytest.mark.parametrize("opener, closer", [("$(a ", ").html("), ("sax ", "parse"), ("exec(a ", "+"), ("fs.stat(a ", "+"), ("require(a ", "+")])
def test_unfinished_openers_take_linear_time(spark, opener, closer):
    times = []
    for n in (200_000, 400_000):
        text = closer + opener * (n // len(opener))
        df = spark.createDataFrame([(text,)], "text string")
        start = time.perf_counter()
        scan(df, "text", [r.rx for r in IDLE_RULES]).count()
        times.append(time.perf_counter() - start)
    assert times[1] < 3 * times[0] + 2 and times[1] < 20


def test_unfinished_bodies_take_linear_time(spark):
    df = spark.createDataFrame([("body:{a " * 60_000,)], "text string")
    start = time.perf_counter()
    assert extract_values(df, "text", IDLE_ITEMS).count() == 0
    assert time.perf_counter() - start < 20


ARROWS = [rx for c in CATEGORIES for rx, _ in detectors(c) if rx.closer]


def test_values_between_closers_equal_a_plain_search(spark):
    rnd = random.Random(4)
    words = ["const a", "let b", "var", " ", "=", "(", ")", "=>", ") =>", "async ", "function", "x", "const f = function", "let g=(y", "function f(", "function ", "$g"]
    lines = [(i, "".join(rnd.choice(words) for _ in range(rnd.randrange(30)))) for i in range(6000)]
    got = extract_values(spark.createDataFrame(lines, "id int, text string").repartition(8), "text", ARROWS, keep=["id"])
    want = [(i, k, n, m.group(1)) for i, x in lines for k, rx in enumerate(ARROWS) for n, m in enumerate(re.finditer(rx.pattern, x, re.S))]
    assert len(want) > 500 and rows(got, "id", "rx", "nth", "value") == sorted(want, key=repr)


@pytest.mark.parametrize("opener", ["const a=(", "const a=(const b=function ", "let a=(x) ", "function f(a "])
def test_openers_without_a_closer_take_linear_time(spark, opener):
    extract_values(spark.createDataFrame([(opener * 10,)], "text string"), "text", ARROWS).count()
    times = []
    for n in (200_000, 400_000):
        df = spark.createDataFrame([(opener * (n // len(opener)),)], "text string")
        start = time.perf_counter()
        extract_values(df, "text", ARROWS).count()
        times.append(time.perf_counter() - start)
    assert times[1] < 2.5 * times[0] + 1 and times[1] < 10


def test_files_left_out_are_not_opened(spark, tmp_path):
    for name, data in {"src/a b.js": "x = 1;", "src/big.mp4": "y" * 5000, "node_modules/m.js": "z" * 5000, "src/b.js.map": '{"sources":["o.ts"],"sourcesContent":["let o;"]}',
                       "src/n.js": "a\0b"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(data)
    old = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        plain = SRC.scan_files(spark, str(tmp_path)).collect()
        with_maps = SRC.scan_files(spark, str(tmp_path), purpose="items", skipped_dirs=["node_modules"]).collect()
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", old)
    assert [(r.path.rsplit("/", 1)[1], r.content) for r in plain] == [("a b.js", "x = 1;")]
    assert sorted((r.path.rsplit("/", 1)[1], r.content) for r in with_maps) == [("a b.js", "x = 1;"), ("b.js.map -> o.ts", "let o;")]


def test_summary_counts_distinct_urls(spark):
    urls = spark.createDataFrame([("https://h/api?a=1&b=2",)] * 3 + [("https://h/x",), ("https://other/",)], "url string")
    assert U.summary(urls, ["h"]).first().asDict() == {
        "total_urls": 2, "clean_paths": 2, "important_paths": 1, "unique_parameters": 2, "out_of_scope_dropped": 1}
    assert U.summary(urls.limit(0)).first().total_urls == 0


def test_stream_of_a_folder_and_of_one_file(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "t[1]"))
    for k, path in enumerate([str(tmp_path / "t[1]") + "/", str(next((tmp_path / "t[1]").glob("part-*")))]):
        ST.write_stream(ST.read_stream(spark, path, "id long"), str(tmp_path / f"o{k}"), str(tmp_path / f"c{k}")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / f"o{k}")).count() == 3
