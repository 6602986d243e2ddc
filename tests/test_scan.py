import random
import re

from conftest import rows

from pagesieve.functions.regex import Rx, glob_to_regex, required_signs, SIGNS
from pagesieve.functions.scan import scan


def expected(texts, rxs, before, after):
    for i, t in enumerate(texts):
        for k, r in enumerate(rxs):
            for n, m in enumerate(re.finditer(r.pattern, t)):
                at = m.start()
                value = m.group(1) if m.re.groups else m.group(0)
                yield (i, k, n, at, t.count("\n", 0, at) + 1, at - (t.rfind("\n", 0, at) + 1) + 1,
                       m.group(0), value, t[max(0, at - before):at], t[m.end():m.end() + after])


def test_positions_match_a_plain_search(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab\n xé😀") for _ in range(n)) for n in (0, 1, 7, 40, 300, 3000) for _ in range(4)]
    rxs = [Rx(r"a\s*b"), Rx(r"x(a+)", ("x",)), Rx("b")]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    want = sorted(expected(texts, rxs, 7, 4), key=repr)
    assert rows(scan(df, "t", rxs, before=7, after=4)) == want
    assert rows(scan(df.repartition(5), "t", rxs, before=7, after=4)) == want


def test_long_texts_do_not_overflow_the_stack(spark):
    from pagesieve.operators.comments import comments
    from pagesieve.operators.findings import findings
    from pagesieve.operators.items import js_items

    n = 200_000
    text = "x = /" + "a" * n + "/g; (" + "b\\\\" * n + "++); s = \"" + "q\\n" * n + "\"; // end\n" + "w" * n
    df = spark.createDataFrame([("a.js", text)], "path string, content string")
    assert ("JS-REDOS-001",) in rows(findings(df, groups=["node"]), "rule_id")
    assert rows(comments(df), "text", "type")[-1] == ("end", "line")
    assert js_items(df, categories=["regex_patterns", "emails"], min_length=1).count() >= 1


def test_globs():
    assert re.search(glob_to_regex("*.min.js"), "a.min.js")
    assert not re.search(glob_to_regex("*.min.js"), "a.js")
    assert re.search(glob_to_regex("app[!0-3]?.js"), "app4x.js")


def test_required_signs_hold_for_alternatives():
    assert [SIGNS[k] for k in required_signs(Rx(r"f\s*\(|g\s*\(x"))] == ["("]
    assert required_signs(Rx(r"f\(|g")) == []
    assert required_signs(Rx(r"(?:a=)?b")) == []


def test_blocks_of_matches_and_any_character(spark):
    from pagesieve.functions.scan import FENCES, SPAN

    rng = random.Random(6)
    texts = ["".join(rng.choice(["ab", "b", "x", "\n", "a \n", FENCES[0], FENCES[1], "xa\n"]) for _ in range(n)) for n in (5, SPAN, 5 * SPAN, 9000)]
    texts.append("".join(FENCES[1:]) + "ab" + "".join(FENCES[1:]) + "xa")
    rxs = [Rx(r"a\s*b"), Rx(r"x(a+)", ("x",)), Rx("b|" + FENCES[0])]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert rows(scan(df, "t", rxs, before=5, after=3)) == sorted(expected(texts, rxs, 5, 3), key=repr)


def test_lines_around_a_match_come_with_its_block(spark):
    text = "".join(f"{k}\r{'a' * (k % 3)}\n" for k in range(4000))
    df = spark.createDataFrame([(text,)], "t string")
    derive = {"here": "get(_all, m.line - _b.since)", "around": "array_join(slice(_all, greatest(m.line - 2, 1) - _b.since + 1, m.line + 1 - greatest(m.line - 2, 1) + 1), '|')"}
    found = scan(df, "t", [Rx("a")], lines={"_all": "split(t, '\\n', -1)"}, margin=(2, 1), derive=derive, keep=[])
    lines = text.split("\n")
    for r in found.collect():
        assert r.here == lines[r.line - 1] and r.around == "|".join(lines[max(r.line - 3, 0):r.line + 1])
