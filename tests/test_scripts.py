"""Endpoints, items and findings against plain searches and hand-made cases."""

import re

from conftest import rows
from pyspark.sql import functions as F

from pagesieve.catalog.endpoint_types import ENDPOINT_TYPES
from pagesieve.catalog.js_categories import CATEGORIES, LINE_CATEGORIES, detectors
from pagesieve.catalog.vuln_rules import TAINT_HINTS, rules
from pagesieve.operators import endpoints as E
from pagesieve.operators import findings as V
from pagesieve.operators import items as I


def corpus(spark, *texts, name="f{}.js"):
    return spark.createDataFrame([(name.format(i), t) for i, t in enumerate(texts)], "path string, content string")


def flags(rx):
    return (re.I if "i" in rx.flags else 0) | (re.S if "s" in rx.flags else 0)


def test_valid_endpoints(spark):
    cases = {"/": False, "#x": False, "javascript:f()": False, "abc": False, "httpx": True, "123": False, "/a.png": True}
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    got = {r.v: (r.ok, r.strict) for r in df.select("v", E.is_endpoint(F.col("v")).alias("ok"), E.is_endpoint(F.col("v"), True).alias("strict")).collect()}
    assert {k: v[0] for k, v in got.items()} == cases
    assert got["/a.png"][1] is False


def test_method_is_read_ahead_of_the_match(spark):
    found = rows(E.endpoints(corpus(spark, 'axios.post("/o/1", p)', 'fetch({method:"put"}); x="/z"')), "url", "endpoint_type", "method")
    assert ("/o/1", "relative_path", "POST") in found and ("/o/1", "ajax_call", None) in found
    assert ("/z", "relative_path", "PUT") in found


def test_endpoint_dedup_keeps_the_first(spark):
    found = E.dedup_endpoints(E.endpoints(corpus(spark, 'a "/a?x=1" b "/a?x=2" c "/a"')))
    assert rows(found, "url") == [("/a?x=1",)]


def test_endpoint_counts_agree_with_plain_search(js):
    texts = [r.content for r in js.collect()]
    got = {r.endpoint_type: r.n for r in E.count_by_type(E.endpoints(js, context=False, method=False)).collect()}
    for name, rx in ENDPOINT_TYPES:
        hits = [m.group(1) if m.re.groups else m.group(0) for t in texts for m in re.finditer(rx.pattern, t, re.I)]
        assert got.get(name, 0) <= len(hits)
    assert got["absolute_url"] == sum(len(re.findall(ENDPOINT_TYPES[0][1].pattern, t, re.I)) for t in texts)


def plain_clean(v):
    v = v.strip()
    if len(v) >= 2 and v[0] in "\"'`" and v[-1] == v[0]:
        v = v[1:-1]
    return v if len(v) <= 500 else v[:500] + "..."


def test_items_agree_with_plain_search(js):
    want = []
    for r in js.collect():
        for c in LINE_CATEGORIES:
            for k, (rx, confidence) in enumerate(detectors(c)):
                for n, line in enumerate(r.content.split("\n"), start=1):
                    for m, hit in enumerate(re.finditer(rx.pattern, line, flags(rx))):
                        value = plain_clean(hit.group(1) if hit.re.groups else hit.group(0))
                        if len(value) >= 3:
                            want.append((r.path, c, value, n, confidence, k, m))
    got = I.js_items(js, categories=LINE_CATEGORIES)
    assert rows(got, "path", "category", "value", "line_number", "confidence", "pattern_ord", "match_ord") == sorted(want, key=repr)


def test_item_rules(spark):
    df = corpus(spark, "class Abcd {}\nclass Ab {}", "class Abcd {}\nx = new Abcd()")
    found = I.js_items(df, categories=["class_names"], context=True)
    assert rows(found, "path", "value", "line_number", "context")[0] == ("f0.js", "Abcd", 1, "class Abcd {}\nclass Ab {}")
    assert rows(I.first_seen(found), "path", "value") == [("f0.js", "Abcd")]
    assert rows(I.at_least(found, "high"), "value") == [("Abcd",), ("Abcd",)]
    stats = {(r.path, r.category): r.n for r in I.stats_per_file(found).collect()}
    assert stats["f1.js", "class_names"] == 2 and stats["f1.js", "urls"] == 0 and len(stats) == 2 * len(CATEGORIES)
    assert rows(I.js_items(df, categories=["class_names"], exclude=["^ABCD$"])) == []
    custom = I.js_items(df, categories=[I.CUSTOM], custom=[("n", "Ab+c", "low")])
    assert {r.confidence for r in custom.collect()} == {"low"}


def test_corrected_expressions(spark):
    df = corpus(spark, 'localStorage["theme"]; "run": function() {}; x = /ab+c/g;', name="c{}.js")
    names = ["local_storage_keys", "function_names", "regex_patterns"]
    assert rows(I.js_items(df, categories=names), "value") == []
    assert {r.value for r in I.js_items(df, categories=names, corrected=True).collect()} == {"theme", "run", "ab+c"}
    bad = corpus(spark, "createHash('md5'); r = /(a+)+/; q.query('SELECT 1' + x); document.cookie = 'a=b; Secure';")
    assert {r.rule_id for r in V.findings(bad, corrected=True).collect()} == {"JS-MD5-001", "JS-REDOS-001", "NODE-SQL-CONCAT-001"}
    assert {r.rule_id for r in V.findings(bad).collect()} == {"JS-COOKIE-INSECURE-001"}


def test_findings_agree_with_plain_search(js):
    want = []
    for r in js.collect():
        lines = r.content.splitlines()
        for rule in rules():
            for m in re.finditer(rule.rx.pattern, r.content, flags(rule.rx)):
                line = r.content.count("\n", 0, m.start()) + 1
                col = m.start() - r.content.rfind("\n", 0, m.start())
                if rule.below and tuple(map(int, m.groups())) >= rule.below:
                    continue
                near = "\n".join(lines[max(0, line - 5):line + 5])
                if rule.taint and not any(h in near for h in TAINT_HINTS):
                    continue
                want.append((rule.rule_id, r.path, line, col, lines[line - 1].strip()[:200]))
    assert rows(V.findings(js), "rule_id", "file", "line", "column", "snippet") == sorted(want, key=repr)


def test_finding_rules(spark):
    found = V.findings(corpus(spark, "a\n eval(x)\nbb eval (y); eval(z)\n"))
    assert rows(found, "line", "column") == [(2, 2), (3, 14), (3, 4)]
    deps = corpus(spark, "jquery-3.4.1", "jquery 3.5.0", "lodash@4.17.20", "lodash@4.17.21")
    assert rows(V.findings(deps), "file") == [("f0.js",), ("f2.js",)]
    hinted = [["x"] * 20 for _ in range(4)]
    for text, at in zip(hinted, (5, 6, 15, 16)):
        text[9], text[at - 1] = "window.open (u)", "location.search"
    texts = ["\n".join(t) for t in hinted]
    assert rows(V.findings(corpus(spark, *texts), groups=["xss"]), "file") == [("f1.js",), ("f2.js",)]
    assert rows(V.exclude_globs(corpus(spark, "", "", name="dist/a{}.min.js"), ["*.min.js"])) == []
    code = "// with (a) { }\nwith (b) { c; }\ns = 'with (d) {'"
    assert rows(V.with_findings(corpus(spark, code)), "line", "column") == [(2, 1)]
    ranked = V.sort_findings(V.findings(corpus(spark, "debugger;\neval(a)", "x\neval(b)")))
    assert [(r.rule_id, r.file) for r in ranked.collect()] == [("JS-EVAL-001", "f0.js"), ("JS-EVAL-001", "f1.js"), ("JS-DEBUGGER-001", "f0.js")]
    assert V.gate(V.findings(corpus(spark, "eval(a)"))).first().exit_code == 1
    assert V.gate(V.findings(corpus(spark, "clean"))).first().exit_code == 0


def test_universal_line_breaks_in_snippets(spark):
    found = V.findings(corpus(spark, "a\x0bb\n  eval(x)  \r\nc"))
    # the line count follows newlines, the snippet follows all line boundaries
    assert rows(found, "line", "snippet") == [(2, "b")]
