"""URLs, responses, pages, links, sources and sinks."""

import json

from conftest import rows
from pyspark.sql import functions as F

from pagesieve.functions import storage
from pagesieve.functions import text as T
from pagesieve.operators import audit as A
from pagesieve.operators import html as H
from pagesieve.operators import links as L
from pagesieve.operators import responses as R
from pagesieve.operators import scripts as S
from pagesieve.operators import urls as U
from pagesieve.sources import corpus as SRC
from pagesieve.sources import sinks as SINK


def urls(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "url string")


def test_scope(spark):
    u = urls(spark, "https://a.example.com/x", "https://example.com/", "https://a.example.com:8443/", "plain.example.com")
    assert rows(U.in_scope(u, ["*.Example.com", "", "# remark"])) == [("https://a.example.com/x",), ("plain.example.com",)]
    assert U.scope_dropped(u, ["*.example.com"]).first()[0] == 2
    many = [f"h{i}.example.net" for i in range(450)] + ["example.com"]
    assert rows(U.in_scope(u, many)) == [("https://example.com/",)]


def test_paths_categories_and_parameters(spark):
    u = urls(spark, "https://h/a#b?x=1", "https://h/a?x=1#y")
    assert rows(U.clean_paths(u)) == [("https://h/a",)]
    c = U.categories(urls(spark, "/.env", "/a.js.map", "/x.sql?y", "/p"))
    assert rows(c, "url", "category") == [("/.env", "backups"), ("/.env", "configs"), ("/a.js.map", "scripts"), ("/x.sql?y", "backups")]
    assert rows(U.parameter_names(urls(spark, "https://h/p?a=1&b=2&c", "/q"))) == [("a",), ("b",)]
    assert rows(U.substitute_parameters(urls(spark, "/p?a=1&b=2#c", "/p?a=3&b=4#c"), "m")) == [("/p?a=m&b=m#c",)]
    assert rows(U.important_paths(urls(spark, "/API/x", "/apix", "/v2"))) == [("/API/x",), ("/v2",)]


def test_differences_with_a_hot_base(spark):
    hot = [(f"https://h/hot?q={i}", "200", str(i % 2)) for i in range(300)]
    other = [("https://h/same?q=1", "200", "10"), ("https://h/same?q=2", "200", "10")]
    r = spark.createDataFrame(hot + other, "url string, status string, length string")
    assert rows(R.differences(r)) == sorted((("https://h/hot", u) for u, _, _ in hot), key=repr)


def test_targets_and_status(spark):
    t = spark.createDataFrame([("example.com/",), ("https://x/",), ("",)], "host string")
    assert rows(t.select(R.normalize_target(F.col("host")))) == sorted([("http://example.com",), ("https://x",), (None,)], key=repr)
    assert rows(R.host_ports(t, ["80", "443"])) == [("http://example.com:443",), ("http://example.com:80",), ("https://x:443",), ("https://x:80",)]
    s = spark.createDataFrame([("a", 200), ("b", 404), ("c", None)], "url string, status_code int")
    assert rows(R.with_ok(s), "url", "ok") == [("a", True), ("b", False), ("c", False)]
    assert R.parse_status_codes("200, 302") == [200, 302]
    line = spark.createDataFrame([("u", "404", "200")], "url string, status string, length string")
    assert rows(R.status_buckets(line)) == []
    assert rows(R.status_buckets(line, substring_mode=True), "bucket") == [("200",)]


def test_obfuscation_gate(spark):
    texts = ["[]! " * 7, "[]()!+", "a=1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(S.is_obfuscated(F.col("t"))).collect()] == [True, False, False]


def test_text_helpers(spark):
    df = spark.createDataFrame([('"abc"',), ("  'x y' ",), ("a" * 501,)], "v string")
    assert [r[0] for r in df.select(T.clean_value(F.col("v"))).collect()] == ["abc", "x y", "a" * 500 + "..."]
    one = spark.range(1)
    assert one.select(T.safe_name(F.lit("https://h/a?b"))).first()[0] == "h_a_b"
    assert one.select(T.strip_ansi(F.lit("\x1b[1;31mx\x1b[0m"))).first()[0] == "x"
    assert one.select(T.html_unescape(F.lit("&amp;lt; &lt;"))).first()[0] == "&lt; <"


def test_html(spark):
    page = (
        '<!-- <a href="/no">x</a> --><script src="a.js?x=1&amp;y=2"></script><script>if (a<b) { s = "<a href=\'/no\'>"; }</script>'
        '<A title="a > b" HREF=/x>1</A><a href="#t">2</a><a href="mailto:q">3</a><a href="https://o.example.net/">4</a>'
        '<div onclick="go(&quot;/y&quot;)">5</div><p onclick="no()">6</p>'
    )
    pages = spark.createDataFrame([("https://h/d/p.html", page)], "url string, html string")
    assert rows(H.script_sources(pages), "script_url") == [("https://h/d/a.js?x=1&y=2",)]
    assert rows(H.inline_scripts(pages), "content") == [("if (a<b) { s = \"<a href='/no'>\"; }",)]
    assert rows(H.links(pages), "link_url") == [("https://h/x",), ("https://o.example.net/",)]
    assert rows(H.internal(H.links(pages)), "link_url") == [("https://h/x",)]
    assert rows(H.event_handlers(pages), "tag", "content") == [("div", 'go("/y")')]
    entities = spark.createDataFrame([("https://h/", '<a href="/caf&eacute;">x</a>')], "url string, html string")
    full = H.attribute(H.tags(entities, names=["a"]), ["href"])
    assert rows(full, "value") == [("/café",)]


def test_reach(spark):
    hub = [("s", f"n{i}") for i in range(200)] + [("n7", "deep"), ("deep", "deeper"), ("n7", "s"), ("deep", "n1")]
    edges = spark.createDataFrame(hub, "src string, dst string")
    got = dict(rows(L.reach(edges, spark.createDataFrame([("s",)], "node string"), 2), "node", "depth"))
    assert got["s"] == 0 and got["n1"] == 1 and got["deep"] == 2 and "deeper" not in got and len(got) == 202


def test_sources(spark, tmp_path):
    folder = tmp_path / "build" / "tree"
    for name, raw in {"src/A.JS": b"let a;\r\nx", "src/b.txt": b"no", "node_modules/c.js": b"no", "src/d.js": b"a\x00b", "src/e.js": b"\xe9a"}.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(raw)
    got = SRC.scan_files(spark, str(folder))
    assert {(r.path.rsplit("/", 1)[1], r.content) for r in got.collect()} == {("A.JS", "let a;\nx"), ("e.js", "éa")}
    (tmp_path / "list.txt").write_text("a\n\n # r\n  b \n")
    assert rows(SRC.read_list(spark, str(tmp_path / "list.txt"))) == [("a",), ("b",)]
    maps = spark.createDataFrame([("m", json.dumps({"sources": ["a.js", "b.js"], "sourcesContent": ["x", None]})), ("n", "{bad")], "path string, content string")
    assert rows(SRC.explode_source_maps(maps), "path", "content") == [("m -> a.js", "x")]


def test_sinks_and_resume(spark, js, tmp_path):
    from pagesieve.operators.items import js_items

    items = js_items(js, categories=["class_names"])
    SINK.write_json(items, str(tmp_path / "j"), total="total_findings")
    assert spark.read.json(str(tmp_path / "j/metadata")).first().total_findings == items.count()
    out = str(tmp_path / "m")
    first = storage.materialize(spark.range(3), out)
    again = storage.materialize(spark.range(9), out, resume=True)
    assert first.count() == again.count() == 3 and storage.is_complete(spark, out)


def test_audit_is_the_union_of_its_families(js):
    whole = A.audit(js)
    per_kind = {k: A.family(js, k).count() for k in A.KINDS}
    assert {r.kind: r["count"] for r in whole.groupBy("kind").count().collect()} == per_kind
    total = A.rollup(whole).filter("source IS NULL").first().n
    assert total == sum(per_kind.values())
    assert whole.count() == A.audit(js.repartition(3)).count()


def test_first_seen_needs_one_shuffle(js):
    from pagesieve.operators.items import js_items

    plain = js_items(js)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plain.split("InMemoryTableScan")[0]


def test_references_are_decoded(spark):
    import html

    cases = ["a", "&", "a&b", "caf&eacute;", "&#233;&#xE9;&#x1F600;", "&#0;", "&#128;", "&#xD800;", "&copy 2", "&nosuch;", "x &amp;lt; y", "&#;", "&#x;", "&AMP;", None, ""]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, s string")
    got = [r.t for r in df.select("i", T.decode_references(F.col("s")).alias("t")).orderBy("i").collect()]
    assert got == [c if c is None else html.unescape(c) for c in cases]
