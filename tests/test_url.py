import random
from urllib.parse import urljoin, urlparse, urlunparse

import pytest

from pagesieve.functions.url import netloc, with_join, with_normalized
from pyspark.sql import functions as F

CASES = [
    ("../c?x=1#f", "https://h.example.com/a/b.js", "https://h.example.com/c?x=1"),
    ("/d", "app.js", "/d"), ("./q/r", "src/app.js", "src/q/r"),
    ("//cdn.x/y", "https://h/a", "https://cdn.x/y"), ("//cdn.x/y", "app.js", ":/cdn.x/y"),
    ("/a/b.,;", "https://h/", "https://h/a/b"),
]


def test_normalize_cases(spark):
    df = spark.createDataFrame(CASES, "u string, b string, want string")
    out = with_normalized(df, "u", "b", "got").collect()
    assert [r.got for r in out] == [r.want for r in out]


def _normalized(url, base):
    url = url.strip().rstrip(".,;:")
    if url.startswith("//"):
        url = f"{urlparse(base).scheme}:{url}"
    if not url.startswith(("http://", "https://", "ws://", "wss://")):
        url = urljoin(base, url)
    p = urlparse(url)
    return urlunparse((p.scheme, p.netloc, p.path, p.params, p.query, ""))


def test_against_the_standard_library(spark):
    rng = random.Random(11)
    parts = ["..", ".", "a", "b", "c;x", "", "app.js", "//", "?q=1", "#f", "x:y", "https:", "http://h.com", "mailto:z",
             "/", "/", "é", "../", ";", "ws://h"]
    bases = ["https://h.example.com/a/b.js", "https://h", "http://h/a//b/", "/abs/p/q.js", "https://h/a/b;p/c;d?x=1#frag", "ws://h/x"]
    data = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 5))), rng.choice(bases)) for _ in range(1500)]
    df = spark.createDataFrame(data, "u string, b string")
    out = with_normalized(with_join(df, "u", "b", "j"), "u", "b", "n").collect()
    assert [r.j for r in out] == [urljoin(r.b, r.u) for r in out]
    assert [r.n for r in out] == [_normalized(r.u, r.b) for r in out]


@pytest.mark.parametrize("url,want", [("https://u@h:8443/x", "u@h:8443"), ("h/x", ""), ("//h?x", "h")])
def test_netloc(spark, url, want):
    assert spark.range(1).select(netloc(F.lit(url)).alias("n")).first().n == want
