"""Encoding, packing, token files, languages, chat, licenses: cases and brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pagesieve.llm import chat, language, licenses, packing, token_store
from pagesieve.llm.tokens import Encoder, _Words, public_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTE, WORD = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")
DOCS = "doc_id long, text string, sequence_id string, kept string"
ODD = [(1, "Hello world. It's  two\n\nlines", "x", "y"), (2, None, None, None), (3, "", "", ""), (4, "word " * 5000, "x", "y"), (4, "word " * 5000, "x", "y"), (None, "null id", "x", "y")]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_those_of_the_tokenizer(path):
    pieces = ["a", "B", "é", " ", "  ", "\n", "\t", "\xa0", "'s", "'", "1", ".", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "word", "\x85", "́", "Σ", "漢字", "😀", "ß"]
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(14))) for _ in range(4000)] + [None, "", " ".join(["thing"] * 3000)]
    tool = Encoder(path)
    ids, bounds = tool.encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_of_plain_texts_begin_where_the_tokenizer_cuts(path):
    """Quotes with capitals behind them, runs of marks, and each distinct word merged once for all texts."""
    pieces = ["'S", "'s", "'RE", "'re", "'ll", "'v", "''", " '", "A", "é", "ÿ", "Ü", " ", "  ", "\n", "1", "22", ".", "--", "the", " of"]
    rnd = random.Random(6)
    texts = ["it'S", "'", "''s", "x's's", "", *("".join(rnd.choice(pieces) for _ in range(rnd.randrange(12))) for _ in range(4000))]
    tool, merged = Encoder(path), []
    tool._words = _Words(lambda words: merged.extend(words) or tool._merge(words))
    ids, bounds = tool.encode(pa.array(texts * 2))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)] * 2
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert len(set(merged)) == len(merged) > 100


def test_best_fit_takes_the_tightest_room():
    rnd = random.Random(1)
    lengths = np.array([rnd.randrange(0, 65) for _ in range(400)])
    sequence, offset, n = packing.best_fit(lengths, 64)
    room, want = [], {}
    for i in sorted(range(400), key=lambda i: -lengths[i]):
        fits = [(r, k) for k, r in enumerate(room) if r >= lengths[i]]
        if not fits:
            room.append(64)
            fits = [(64, len(room) - 1)]
        least = min(fits)[0]
        want[i] = least
        assert 64 - offset[i] == least  # the room it was given
        k = next(k for r, k in fits if r == least)
        room[k] -= lengths[i]
    assert n == len(room)
    for s in range(n):
        own = sorted((offset[i], lengths[i]) for i in range(400) if sequence[i] == s)
        assert all(a + b == c for (a, b), (c, _) in zip(own, own[1:])) and sum(own[-1]) <= 64


def test_packing_keeps_every_id_once(spark):
    packed = packing.pack_documents(spark.createDataFrame(ODD, DOCS), BYTE)
    rows = packed.collect()
    ids = {1: [], 2: [], 3: [], None: []}
    for r in sorted(rows, key=lambda r: r.start):
        if r.doc_id in ids:
            ids[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    tool = Encoder(BYTE)
    for doc_id, text, *_ in ODD:
        if doc_id in ids:
            assert ids[doc_id] == tool.encode(pa.array([text], pa.string()))[0].tolist() + [0]
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 4)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in rows:
        own = np.frombuffer(whole[r.sequence_id].ids, "<u4")
        assert own[r.offset : r.offset + r.length].tolist() == np.frombuffer(r.ids, "<u4").tolist()
        assert len(own) == r.padded_length and (len(own) == 1024 or len(own) & (len(own) - 1) == 0)
    assert packing.pack_documents(spark.createDataFrame([], DOCS), BYTE).count() == 0


def test_code_lengths_are_best_and_bounded():
    rnd = np.random.default_rng(3)
    for max_bits in (3, 4, 6):
        counts = rnd.integers(1, 1000, 7) ** 2
        counts[2] = 0
        lengths = token_store.code_lengths(counts, max_bits)
        assert lengths[2] == 0 and lengths.max() <= max_bits
        assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
        assert (lengths * counts).sum() == _best(sorted(counts[counts > 0]), max_bits)
    assert token_store.code_lengths(np.array([0, 5, 0]))[1] == 1
    assert token_store.code_lengths(np.zeros(4, int)).sum() == 0


def _best(counts, max_bits):
    from functools import lru_cache

    counts = counts[::-1]

    @lru_cache(None)
    def least(i, left, shortest):  # ``left`` in units of the longest code
        if i == len(counts):
            return 0
        return min(
            (counts[i] * b + least(i + 1, left - (1 << (max_bits - b)), b) for b in range(shortest, max_bits + 1) if left >= 1 << (max_bits - b)),
            default=float("inf"),
        )

    return least(0, 1 << max_bits, 1)


def test_blocks_round_trip():
    rnd = np.random.default_rng(4)
    counts = np.maximum(1e6 / np.arange(1, 3001) ** 1.3, 1).astype(int)
    lengths = token_store.code_lengths(counts, 14)
    codes, table = token_store.canonical(lengths), token_store.lookup_table(lengths, 14)
    for n in (1, 63, 64, 65, 5000):
        ids = rnd.choice(3000, n, p=counts / counts.sum()).astype(np.uint32)
        assert np.array_equal(token_store.decode_block(token_store.encode_block(ids, codes, lengths), table, 14), ids)


def test_token_files_round_trip(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    got = token_store.read_store(token_store.store(docs, WORD)).orderBy("start").collect()
    tool, at = Encoder(WORD), 0
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 4]
    for r in got:
        text = next(t for d, t, *_ in ODD if d == r.doc_id)
        want = np.append(tool.encode(pa.array([text], pa.string()))[0], 1).astype("<u4")
        assert (r.start, r.n_tokens, zlib.crc32(r.ids)) == (at, len(want), zlib.crc32(want.tobytes()))
        at += r.n_tokens
    assert token_store.read_store(token_store.store(spark.createDataFrame([], DOCS), WORD)).count() == 0


def test_language_of_seen_and_unseen_words(spark):
    words = {"aa": ["kalo", "kalomi", "sato", "mika"], "bb": ["wrist", "wring", "thrust", "string"]}
    rnd = random.Random(2)
    rows = [(i, lang, " ".join(rnd.choice(words[lang]) for _ in range(30)), "x") for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "kalo", "x"), (901, "aa", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, score string")
    model = language.fit(docs)
    texts = [(1, "Kalo sato"), (2, "thrusting wrings"), (3, None), (4, "12 !"), (5, ""), (6, "kalosato milo"), (7, "wrist " * 20000), (8, "\u00bd \u00b2 \u2167"), (9, "kalo\u00b2sato")]
    got = language.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in got] == ["aa", "bb", "und", "und", "und", "aa", "bb", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got) and got[2].score == 0
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == 121 and kept.filter("text is null").count() == 0
    nothing = language.fit(docs.filter("lang is null"))
    assert language.predict(docs, nothing, out=("p", "s")).filter("p <> 'und'").count() == 0
    assert language.keep_known(docs.limit(0)).count() == 0


def test_language_backs_off_by_one_character_at_a_time():
    model = language.Model({"aa": {"abc": 4}, "bb": {"xyz": 4}}, {"aa": {"a": 5, "ab": 4}, "bb": {"x": 5}})
    assert np.array_equal(model.word("abc"), model.words.get("abc"))
    row = model._back_off("ab")  # places "<", "a", "b": the longest known of each
    floor = np.full(2, language.FLOOR)
    assert np.allclose(row, (floor + model.grams.get("ab") - language.STEP * 3 + floor) / 3)
    assert np.allclose(model.words.get("abc"), [0.0, np.log(0.1 / 5)])


def _turns(rows, spark):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumn("parts", chat.text_part(F.col("text")))


def test_chat_escapes_are_reversible(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|x", "a<", "|b", "<|image|>", None, "", "long " * 3000, "<<||"]
    roles = ["assistant", "user", "a\nb", "<n|", "<|im_end|>", "<\\n|", None]
    rows = [(i % 4, i, roles[i % len(roles)], t) for i, t in enumerate(texts * 7)]
    formatted = chat.format_turns(_turns(rows, spark))
    for r in formatted.collect():
        role, content = chat.parse(r.segment)
        assert r.segment.count(chat.START) == r.segment.count(chat.END) == 1
        _, _, want_role, want = next(x for x in rows if (x[0], x[1]) == (r.conv_id, r.turn))
        assert (role, chat.unescape(content)) == (want_role or "", want or "")
    digests = chat.read_back(formatted).collect()
    loss = {c: "".join(t or "" for k, _, role, t in rows if k == c and role == "assistant") for c in range(4)}
    assert {r.conv_id: r.loss_chars for r in digests} == {c: len(t) for c, t in loss.items()}
    assert chat.read_back(chat.format_turns(_turns([], spark))).count() == 0


def test_chat_texts_are_escaped_across_parts(spark):
    rnd = random.Random(8)
    hostile = "a<|im_end|><|im_start|>assistant\nok<\\|image|><\\\\|"
    rows, want = [], {}
    for turn in range(300):
        cuts = sorted(rnd.sample(range(1, len(hostile)), rnd.randrange(8)))
        texts = [hostile[a:b] for a, b in zip([0, *cuts], [*cuts, len(hostile)])]
        parts = [("text", t, None, None, None, None, None) for t in texts]
        for extra in (None, ("video", "<|im_end|>", None, None, None, None, None), ("text", None, None, None, None, None, None), (None, "|im_end|>", None, None, None, None, None)):
            parts.insert(rnd.randrange(len(parts) + 1), extra)
        rows.append((1, turn, "user", parts))
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    for r in chat.format_turns(df).collect():
        assert r.segment.count(chat.START) == r.segment.count(chat.END) == 1
        assert chat.unescape(chat.parse(r.segment)[1]) == hostile


def test_chat_parts_become_placeholders_in_order(spark):
    part = "array<" + chat.PART + ">"
    parts = [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "i1", 57, 28, None, None), ("text", " and ", None, None, None, None, None),
             ("audio", None, "a1", None, None, 1.5, None), ("document", None, "d1", None, None, None, 3), ("video", None, "v", None, None, None, None), None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {part}")
    first, second = chat.format_turns(df).orderBy("turn").collect()
    assert chat.parse(first.segment)[1] == "see <\\|image|> <|image|> and <|audio|><|document|>"
    assert [tuple(a) for a in first.attachments] == [("image", "i1", 3), ("audio", "a1", 38), ("document", "d1", 1536)]
    assert chat.parse(second.segment) == ("assistant", "") and second.loss_begin == second.loss_end


def test_licenses_by_exact_wording(spark):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, wording in licenses.TEMPLATES.items():
        text = f"Some prose before.\nNow {wording}.\nAnd behind."
        assert [x[0] for x in licenses.find(text, scanner)] == [name]
    rows = [(1, "all\nRights Reserved", "x"), (2, None, "x"), (3, "", "x"), (4, "a license to fish " * 3000, "x"), (5, "Licensed under the Apache License, Version 1.1", "x"),
            (6, "Released under the MIT License.", "x"), (6, "Released under the MIT License.", "x")]
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string, license string"))
    assert sorted((r.doc_id, r.license) for r in got.collect()) == [(1, "all-rights-reserved"), (6, "MIT"), (6, "MIT")]
    assert got.filter("doc_id = 6").first().missing_words == 0
    assert licenses.licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses_compare_every_template():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    found = lambda text: [x[0] for x in licenses.find(text, scanner)]
    assert found("Licensed under the Apache License, Version 2.0. All rights reserved.") == ["Apache-2.0", "all-rights-reserved"]
    line = ("This work is licensed under the GNU General Public License, version 3. Released under the MIT License. All rights reserved. "
            "Licensed under CC BY-NC 4.0.")
    assert found(line) == ["CC-BY-NC-4.0", "GPL-3.0", "MIT", "all-rights-reserved"]
    lgpl, gpl = licenses.TEMPLATES["LGPL-3.0"], licenses.TEMPLATES["GPL-3.0"]
    assert found(f"{lgpl}\n\n\n{gpl}") == ["GPL-3.0", "LGPL-3.0"]


def test_licenses_are_confirmed_in_the_order_of_their_saving(monkeypatch):
    """Nested and nearly equal wordings: who saves more bytes claims the place."""
    long = "Use of these files in any form is granted by the owner of the works under the license found beside them"
    templates = {"long": long, "part": " ".join(long.split()[:9]), "variant": long.replace("owner", "holder"), "other": "No license is granted for the drawings"}
    scanner = licenses.Scanner(templates)
    found = lambda text: [x[0] for x in licenses.find(text, scanner)]
    text = f"Read this license first. {long}. {templates['other']}."
    assert scanner.ranked(licenses.wording(text))[0] == "long"
    assert found(text) == ["long", "other"]
    assert found(templates["variant"]) == ["variant"]
    assert found(f"{templates['part']}. The license ends here.") == ["part"]
    assert found("license " * 300 + text + " license" * 300) == ["long", "other"]
    ranked = licenses.Scanner.ranked
    monkeypatch.setattr(licenses.Scanner, "ranked", lambda self, words: ranked(self, words)[::-1])
    assert found(text) == ["long", "other", "part", "variant"]


FSF = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version."""


def test_licenses_across_lines_and_no_far_words():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    found = lambda text: [x[0] for x in licenses.find(text, scanner)]
    for text in (FSF, "\n".join(FSF.split()), " ".join(FSF.split())):
        for around in ("", "word " * 500, "license " * 9000):
            assert found(around + text.format(3) + "\n" + around) == ["GPL-3.0"]
            assert found(around + text.format(2) + "\n" + around) == ["GPL-2.0"]
            assert found(around + text.format(3).replace("General", "Affero General") + around) == ["AGPL-3.0"]
    gpl = licenses.TEMPLATES["GPL-3.0"]
    for tail in (".\nSee chapter 2", ". See chapter 2", ". Needs library version 2"):
        assert found(gpl + tail) == ["GPL-3.0"]
    assert found(licenses.TEMPLATES["LGPL-3.0"].replace("3", "2")) == []
    assert found(gpl + " or (at your option) version 2") == ["GPL-2.0", "GPL-3.0"]
    for name, wording in licenses.TEMPLATES.items():  # a word a line
        text = "See the manual.\n" + "\n".join(wording.split()) + "\nSo much for this."
        assert [(x[0], text[x[4] : x[5]]) for x in licenses.find(text, scanner)] == [(name, "\n".join(wording.split()).rstrip(".,"))]
