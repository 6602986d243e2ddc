"""WARC packages, decontamination, line and document dedup, quality: cases and brute force."""

import io
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesieve.llm import decontaminate, graph, line_dedup, quality, simhash, warc



class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(monkeypatch, wide):
    if wide:  # every size and place is then written in 64 bits
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = Source()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/é.txt", b"first member")
        z.writestr("b.bin", b"PK\x05\x06" * 30, zipfile.ZIP_DEFLATED)
        z.writestr("c.bin", b"third")
        z.comment = b"a remark PK\x05\x06 in it"
    for prefix in (b"",) if wide else (b"", b"#!/bin/sh\n"):
        source = Source(prefix + out.getvalue())
        members = {m.name: m for m in warc.directory(source)}
        assert list(members) == ["a/é.txt", "b.bin", "c.bin"]
        for name, data in (("a/é.txt", b"first member"), ("c.bin", b"third")):
            at = warc.stored_at(source, members[name])
            assert source.getvalue()[at : at + members[name].size] == data
        with pytest.raises(ValueError):
            warc.stored_at(source, members["b.bin"])
    with pytest.raises(ValueError):
        warc.directory(Source(b"no archive at all"))


def test_archive_without_index_is_walked():
    import gzip

    records = [warc.record(i, f"http://h/{i}", b"x" * i, "d", None) for i in range(5)]
    packed = [gzip.compress(r) for r in records]
    out = Source()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/data.warc.gz", b"".join(packed))
    begin, entries = warc.index_of(out)
    assert [gzip.decompress(out.getvalue()[begin + a : begin + a + n]) for a, n in entries] == records


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_RECORDS", 3)
    big, small = "<p>é" + "x" * 200, "tiny"
    rows = [(5, "http://a/ b\r\nX: y", big, 1), (3, None, big, 1), (9, "u", big, 1), (7, "u", small, 1), (8, "u", small, 1), (1, "u", None, 1), (2, "u", "", 1),
            (None, "u", big, 1), (3, None, big, 1), (11, "u", "WARC/1.1\r\n\r\n" * 20000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = warc.read_packages(warc.write_packages(pages, f"file://{tmp_path}")).collect()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "response", None), (1, "response", None), (2, "response", None), (3, "response", None), (3, "response", None),
                     (5, "revisit", 3), (7, "response", None), (8, "response", None), (9, "revisit", 3), (11, "response", None)]
    for r in got:
        html = next(h for p, _, h, _ in rows if p == r.page_id) or ""
        assert r.told_bytes == len(html.encode()) and (r.payload is None or r.payload.decode() == html)
    assert next(r.url for r in got if r.page_id == 5) == "http://a/%20b%0D%0AX:%20y"
    assert warc.read_packages(warc.write_packages(pages.limit(0), f"file://{tmp_path}/none")).count() == 0


def _edits(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != d), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def test_decontamination_finds_what_the_budget_allows():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8)))
    items = [" ".join(word() for _ in range(rnd.randrange(6, 30))) for _ in range(12)]
    index, within = decontaminate.Index(items), 0
    for _ in range(120):
        k = rnd.randrange(12)
        spoilt = bytearray(index.items[k])
        for _ in range(rnd.randrange(int(index.budget[k]) + 4)):
            at = rnd.randrange(len(spoilt))
            kind = rnd.randrange(3)
            if kind == 0:
                spoilt[at] = rnd.choice(b"abcz")
            elif kind == 1:
                del spoilt[at]
            else:
                spoilt.insert(at, rnd.choice(b"abcz "))
        text = " ".join([*(word() for _ in range(rnd.randrange(20))), spoilt.decode(), *(word() for _ in range(rnd.randrange(20)))])
        edits = _edits(index.items[k], decontaminate.normal(text))
        found = {m[1]: m for m in index.find(["", text, "other"]) if m[0] == 1}
        assert (edits <= index.budget[k]) == (k in found)
        if k in found:
            assert found[k][2] == edits
            within += 1
    assert within > 40


def test_bands_of_equal_width_are_aligned_together(monkeypatch):
    """Many near passages cost steps for the longest of them, not for each; the places are those of each band alone."""
    rnd = random.Random(9)
    bands = []
    for _ in range(300):
        item = bytes(rnd.choice(b"abc ") for _ in range(rnd.randrange(8, 40)))
        spoilt = bytearray(item)
        for _ in range(rnd.randrange(4)):
            spoilt[rnd.randrange(len(spoilt))] = rnd.choice(b"abcz")
        before = bytes(rnd.choice(b"abc ") for _ in range(rnd.randrange(12)))
        bands.append((item, before + bytes(spoilt) + b" ab", rnd.randrange(4), len(before) - rnd.randrange(8), 8))
    steps, take = [], np.take_along_axis
    monkeypatch.setattr(np, "take_along_axis", lambda *a: steps.append(1) or take(*a))
    together = decontaminate.align(bands)
    assert len(steps) <= 40
    assert together == [decontaminate.align([b])[0] for b in bands]
    for (item, text, budget, low, width), place in zip(bands, together):
        inside = text[max(0, low) :]
        assert place is None or place[0] <= budget and _edits(item, inside) <= place[0] and _edits(item, text[place[1] : place[2]]) <= place[0]
        if low <= 0 and low + width > len(text):
            assert (place is not None) == (_edits(item, text) <= budget)
    assert sum(p is not None for p in together) > 50


def test_decontamination_tables(spark):
    item = "The quick brown fox jumps over the lazy dog, and then it rests for a while"
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, "hi", 0), (5, item.upper(), 0)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame(
        [(1, "Well: the QUICK brown fox -- jumps over the lazy dog and then it rests for a while!", "x"), (2, None, "x"), (3, "", "x"), (4, "hi there", "x"),
         (5, "filler words " * 30000 + item, "x"), (6, item[: len(item) // 2], "x"), (None, item, "x"), (1, "clean repeat of an id", "x")],
        "doc_id long, text string, item_id string")
    got = decontaminate.matches(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.edits) for r in got) == [(d, i, 0) for d in (0, 1, 5) for i in (1, 5)]
    long = next(r for r in got if r.doc_id == 5)
    assert ("filler words " * 30000 + item)[long.begin : long.end] == item
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6]
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.matches(docs.limit(0), bench).count() == 0


def test_decontamination_finds_parts_of_items(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9)))
    words = [word() for _ in range(60)]
    n = decontaminate.PASSAGE
    parts = [words[:50], words[9:], words[:30], words[20 : 20 + n], words[60 - n :], words[:n], words[9 : 9 + n // 2], words[::2]]
    around = lambda x: " ".join([*(word() for _ in range(30)), *x, *(word() for _ in range(30))])
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "字" * 400)], "item_id long, text string")
    texts = [around(p) for p in parts] + [" ".join(p) for p in parts] + [around(["字" * 250])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.matches(docs, bench).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13, 16]
    assert all(r.edits == 0 and r.item_id == 1 for d, r in got.items() if d < 16) and got[16].item_id == 2
    assert texts[3][got[3].begin : got[3].end] == " ".join(parts[3])
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [6, 7, 14, 15]
    spoilt = " ".join(words[10:40]).replace(words[20], words[20] + "x", 1)
    assert decontaminate.matches(spark.createDataFrame([(1, spoilt)], "doc_id long, text string"), bench).count() == 1


def _similar(a, b):
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    line = lambda: " ".join(rnd.choices(words, k=rnd.randrange(1, 16)))
    pool = [line() for _ in range(60)]

    def near(x):
        out = x.split()
        if rnd.random() < 0.7:
            out[rnd.randrange(len(out))] = rnd.choice(words)
        return " ".join(out).upper() if rnd.random() < 0.3 else "  ".join(out)

    texts = ["\n".join(near(rnd.choice(pool)) if rnd.random() < 0.7 else line() for _ in range(rnd.randrange(1, 8))) for _ in range(150)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(200, None, "x", 1), (201, "", "x", 1), (202, "\n \n", "x", 1), (203, "lone " * 4000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, doc int")
    seen, want = [], {}
    for i, text, *_ in rows:
        kept = []
        for x in (text or "").split("\n"):
            tokens = set(x.lower().split())
            if not tokens or not any(_similar(tokens, s) for s in seen):
                kept.append(x)
            if tokens:
                seen.append(tokens)
        want[i] = None if text is None else "\n".join(kept)
    got = line_dedup.dedup_lines(docs)
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    twice = line_dedup.dedup_lines(spark.createDataFrame([(None, "one two\none two"), (1, "one two"), (1, "one two")], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in twice.collect()) == [(0, "one two"), (1, ""), (1, "")]


def test_line_dedup_of_large_groups_of_near_copies(spark):
    """Chains of near copies, ties, first candidates that don't match, and copies whose earlier match went itself."""
    rnd = random.Random(17)
    words = [f"v{i}" for i in range(300)]
    rows = []
    for g in range(4):
        x = rnd.sample(words, 30)
        for k in range(60):
            if g % 2:
                x = x[:]  # drifts away, so that the last is far from the first
            y = x if g % 2 else x[:]
            for _ in range(rnd.randrange(3)):
                y[rnd.randrange(30)] = rnd.choice(words)
            rows.append((rnd.randrange(10_000), " ".join(y)))
    rows += [(20_000 + i, " ".join(rnd.sample(words, rnd.randrange(1, 6)))) for i in range(60)]
    rows = list(dict(rows).items())
    seen, want = [], set()
    for i, text in sorted(rows):
        tokens = set(text.split())
        if not any(_similar(tokens, s) for s in seen):
            want.add(i)
        seen.append(tokens)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = docs.withColumn("_kept", F.lit(1)).withColumn("_lines", F.lit("x"))
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    got = got.collect()
    assert {r.doc_id for r in got if r.n_removed == 0} == want and 60 < len(want) < len(rows)
    assert all(r._kept == 1 and r._lines == "x" for r in got)


def test_components_equal_plain_search(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_links_equal_brute_force(spark):
    rnd = random.Random(2)
    fps = [rnd.getrandbits(64) for _ in range(150)]
    for base in fps[:40]:
        x = base
        for _ in range(rnd.randrange(1, 5)):
            for _ in range(rnd.randrange(1, 7)):
                x ^= 1 << rnd.randrange(64)
            fps.append(x)
    ball = [fps[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    fps = sorted({*fps, *ball})
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), tile_rows=32)
    found = {r.node: r.component for r in graph.components(links).collect()}
    groups = {}
    for x, (s,) in zip(fps, signed):
        groups.setdefault(find(x), set()).add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_documents(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text, "x"), (3, text.replace("word7 ", "other "), "x"), (9, None, "x"), (8, " \n", "x"), (4, "One\ttwo", "x"), (4, "one TWO", "x"), (None, text, "x"),
            (12, "deep " * 70000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 3), (3, 3), (4, 4), (4, 4), (5, 3), (8, 8), (9, 8), (12, 12)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 8, 12]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_rows_without_or_with_one_id_are_documents_of_their_own(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(0), "a"), (None, text(1), "b"), (None, text(1), "b"), (7, text(2), "c"), (7, text(3), "d"), (2, text(3), "e"), (None, text(2), "f")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns and sorted(r.source for r in kept.collect()) == ["a", "b", "c", "e"]
    docs = spark.createDataFrame([(1, "a b c d e f\nk l m n"), (1, "g h i j\na b c d e f"), (None, "o p q r"), (None, "s t u v\no p q r")], "doc_id long, text string")
    got = [r.text for r in line_dedup.dedup_lines(docs).collect()]
    lines = [x for t in got for x in t.split("\n") if x]
    assert sorted(lines) == ["a b c d e f", "g h i j", "k l m n", "o p q r", "s t u v"]


def test_quality_counts(spark):
    rows = [(1, "a b c d e x a b c d e x y", "en"), (2, None, "en"), (3, "", None), (4, "l #1\nl #1\n\n\nl #1 ", "en"), (5, "same " * 30000, "en"), (None, "a b", None)]
    got = {r.doc_id: r for r in quality.measures(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, stratum int")).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].word_chars) == (13, 12, 13)
    assert (got[2].n_words, got[3].n_words, got[5].n_repeat_words) == (0, 0, 30000)
    assert (got[4].n_symbols, got[4].n_dup_lines, got[4].n_lines) == (3, 1, 3)


def test_quality_cutoffs_keep_good_documents(spark):
    rnd = random.Random(4)
    text = lambda noisy: " ".join(("##" if rnd.random() < noisy else "") + f"w{rnd.randrange(10**6)}" for _ in range(20))
    rows = [(i, text(0.9 if i % 5 == 0 else 0.0), "aa") for i in range(3000)] + [(i, text(0.9), "bb") for i in range(3000, 3050)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(3050)] + [(None, 1, 0), (7, None, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert not any(got[i].kept for i in range(0, 3000, 5))
    assert sum(not got[i].kept for i in range(3000) if i % 5) <= 0.04 * 2400
    assert all(got[i].kept for i in range(3000, 3050))  # too few labels for a cutoff
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.judge(docs.limit(5), labels.limit(0)).count() == 5


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    n, k, rate = 700, 4, 0.01
    want = sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))
    df = spark.createDataFrame([(n, k), (n, 8)], "n long, k long").select(quality._tail(F.col("n"), F.col("k"), rate).alias("p"))
    got = [r.p for r in df.collect()]
    assert got[0] == pytest.approx(want, rel=1e-9) and got[1] == 1.0


def test_near_copies_are_not_compared_pair_by_pair(spark, monkeypatch):
    """The first of a group is just not similar to the others, which are similar to each other."""
    rnd = random.Random(3)
    base = [f"word{i}" for i in range(40)]

    def copy(k, n):
        words = list(base)
        for j, at in enumerate(rnd.sample(range(40), n)):
            words[at] = f"own{k}x{j}"
        return " ".join(words)

    texts = [copy(0, 3), *(copy(k, 2) for k in range(1, 160))]
    sets = [set(t.split()) for t in texts]
    goes = [any(5 * len(a & b) >= 4 * len(a | b) for a in sets[:k]) for k, b in enumerate(sets)]
    counts, written = {}, line_dedup.written

    def counted(df, path):
        out = written(df, path)
        counts["/".join(path.split("/")[-2:])] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs).select("doc_id", "n_removed").collect()}
    assert [got[k] == 1 for k in range(160)] == goes and sum(goes) > 150
    assert sum(n for path, n in counts.items() if path.endswith("/pairs")) < 10 * 160  # all pairs with those that the first leaves: 4959


def test_long_lines_meet_by_all_bits(spark):
    """Long lines of other words fill 64 bits; they aren't candidates of each other."""
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(900)]
    lines = [" ".join(rnd.sample(vocabulary, 130)) for _ in range(150)]
    bits = F.array(*line_dedup._words(F.col("k"))).alias("bits")
    sets = spark.createDataFrame(list(enumerate(lines)), "id long, line string").select("id", line_dedup.tokens_of(F.col("line")).alias("k"))
    sets = sets.select("id", F.size("k").alias("n"), bits, F.slice("k", 1, 27).alias("prefix"))
    sets = sets.select("id", "n", *(F.col("bits")[j].alias(w) for j, w in enumerate(line_dedup.WORDS)), F.expr("transform(prefix, t -> cast(t & 2147483647 as int))").alias("prefix"))
    left = line_dedup._without(sets.withColumn("gone", F.lit(False)), spark.createDataFrame([], "later long"))
    assert sum(line_dedup._all_met(left, k).count() for k in range(line_dedup.PASSES)) == 0


def test_line_dedup_makes_tokens_once(spark, monkeypatch):
    """Lines are split into words in one place of the plan, and kept for both their uses; the counts of rarity read no text."""
    docs = spark.createDataFrame([(1, "a b c d\ne f g h"), (2, "a b c d")], "doc_id long, text string")
    plan = line_dedup.lines_of(docs, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(line") == 1
    plans, table = [], line_dedup.rarity_classes

    def seen(lines, *more):
        plans.append(lines._jdf.queryExecution().withCachedData().toString())
        return table(lines, *more)

    monkeypatch.setattr(line_dedup, "rarity_classes", seen)
    assert line_dedup.kept_lines(docs).count() == 1
    assert len(plans) == 1 and "InMemoryRelation" in plans[0]


def test_line_dedup_of_all_sizes_equals_brute_force(spark):
    """Near copies about the limit, of sizes on both sides of the bands and of ``LARGE``, in any order of sizes."""
    rnd = random.Random(23)
    words = [f"x{i}" for i in range(4000)]
    texts = []
    for size in (4, 5, 6, 9, 10, 11, 24, 45, 88, 150, 161, 170, 199, 260, 520, 900):
        base = rnd.sample(words, size)
        texts.append(base)
        for _ in range(10):
            cut = rnd.randrange(0, 1 + size // 4)
            y = rnd.sample(base, size - cut) + rnd.sample(words, rnd.randrange(0, 1 + size // 8))
            texts.append(y)
    rnd.shuffle(texts)
    seen, want = [], []
    for i, x in enumerate(texts):
        if not any(_similar(set(x), s) for s in seen):
            want.append(i)
        seen.append(set(x))
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    got = line_dedup.dedup_lines(docs).filter("n_removed = 0").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == want and 20 < len(want) < len(texts) - 20
    # The bits never differ in more places than the sets do in tokens.
    k = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "id long, line string").select("id", line_dedup.tokens_of(F.col("line")).alias("k"))
    k = k.select("id", "k", F.size("k").alias("n"), *line_dedup._words(F.col("k")))
    more = F.size(F.array_except("a.k", "b.k")) + F.size(F.array_except("b.k", "a.k"))
    pairs = k.alias("a").join(k.alias("b"), F.col("a.id") < F.col("b.id"))
    for ws in (line_dedup.WORDS[:2], line_dedup.WORDS):
        assert pairs.filter(line_dedup._differ("a", "b", ws) > more).count() == 0
