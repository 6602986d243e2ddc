import random

import pytest
from conftest import rows

from pagesieve.catalog.languages import BY_KEY, LANGUAGES
from pagesieve.operators import comments as C


def walk(text, lang):
    """One pass over the text, kept apart from the library's expressions."""
    blocks = sorted(lang.block, key=lambda b: -len(b[0]))
    lines = sorted(lang.line, key=len, reverse=True)
    strings = sorted(lang.strings, key=len, reverse=True)
    i, out = 0, []
    while i < len(text):
        start = text.count("\n", 0, i) + 1
        block = next((b for b in blocks if text.startswith(b[0], i)), None)
        if block:
            at = i + len(block[0])
            end = text.find(block[1], at)
            body = text[at:] if end < 0 else text[at:end]
            if end >= 0 or body:
                out.append((start, start + body.count("\n"), body.strip(), "block"))
            i = len(text) if end < 0 else end + len(block[1])
            continue
        word = i > 0 and (text[i - 1].isalnum() or text[i - 1] == "_")
        line = next((m for m in lines if text.startswith(m, i) and not (m.isalnum() and word)), None)
        if line:
            at = i + len(line)
            end = text.find("\n", at)
            if end >= 0 or at < len(text):
                out.append((start, start, text[at:None if end < 0 else end].strip(), "line"))
            i = len(text) if end < 0 else end + 1
            continue
        quote = next((s for s in strings if text.startswith(s, i)), None)
        if quote:
            i += len(quote)
            while i < len(text):
                if lang.escape and text[i] == lang.escape and i + 1 < len(text):
                    i += 2
                elif text.startswith(quote, i):
                    break
                else:
                    i += 1
            i += len(quote)
            continue
        i += 1
    return out


def test_every_language_agrees_with_a_walk(spark):
    rng = random.Random(3)
    data = []
    for lang in LANGUAGES:
        marks = [*lang.line, *[m for b in lang.block for m in b], *lang.strings, lang.escape or "x", "\n", " ", "a", "_", "R"]
        ext = lang.extensions[0]
        for k in range(120):
            data.append((f"{lang.key}/{k}{ext}", "".join(rng.choice(marks) for _ in range(rng.randint(1, 14)))))
    df = spark.createDataFrame(data, "path string, content string")
    want = [(p, *c) for p, t in data for c in walk(t, BY_KEY[p.split("/")[0]])]
    assert rows(C.comments(df), "path", "line_start", "line_end", "text", "type") == sorted(want, key=repr)


@pytest.mark.parametrize("path,text,want", [
    ("a.js", 'var u="http://x"; // c1\n/* b\n2 */ x=\'//no\'; /* open', [(1, 1, "c1", "line"), (2, 3, "b\n2", "block"), (3, 3, "open", "block")]),
    ("a.html", "<p>don't <!-- a --> it's <!-- b -->", [(1, 1, "b", "block")]),
    ("a.lua", "--[[ x ]] -- y", [(1, 1, "x", "block"), (1, 1, "y", "line")]),
    ("a.js", "/*", []), ("b.js", "//", []), ("c.js", "//\n", [(1, 1, "", "line")]),
    ("a.bat", "REM hi", [(1, 1, "hi", "line")]), ("a.cmd", "xREM no", []), ("b.bat", "REMOVE", [(1, 1, "OVE", "line")]),
    ("x.bin", "# no", []),
])
def test_cases(spark, path, text, want):
    df = spark.createDataFrame([(path, text)], "path string, content string")
    assert rows(C.comments(df), "line_start", "line_end", "text", "type") == sorted(want, key=repr)


def test_language_and_paths(spark):
    names = {"A.JS": "JavaScript / TypeScript", "d/Dockerfile": "Dockerfile / Makefile", ".vimrc": "Vim Script", "x.bin": None}
    df = spark.createDataFrame([(n, "") for n in names], "path string, content string")
    assert {r.path: r.language for r in C.detect_language(df).collect()} == names
    some = spark.createDataFrame([("a/node_modules/x.js", ""), ("a/build.js", ""), ("a/y.py", "")], "path string, content string")
    assert rows(C.select_paths(some, extensions=[".js"]), "path") == [("a/build.js",)]
