"""Prefix trie, conversation repair, byte-level BPE: beside plain versions."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict
from itertools import groupby

import public_tokenizers
import pytest
import tiktoken
from conftest import FOLDER

from pagesieve.llm import byte_bpe, prefix_trie, queries, repair
from pagesieve.llm.ship import ship

TURNS = "conv_id long, turn long, role string, text string, nr string, digest int, parent string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_conversation(rows, empty):
    found = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        found[conv].append((turn is not None, turn or 0, empty if role is None else role, empty if text is None else text, turn))
    return {c: sorted(v, key=lambda r: r[:4]) for c, v in found.items()}


# --- prefix trie -----------------------------------------------------------------------------


def plain_trie(conversations):
    """The contract's columns from (conv, [(role, text), ...])."""
    members = defaultdict(set)
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(conv)
    out = []
    for node, convs in members.items():
        d = len(node)
        below = [n for n in members if n[:d] == node]
        childless = [n for n in below if not any(m[:-1] == n for m in members if len(m) == len(n) + 1)]
        ends = sorted(c for c in convs if len(conversations[c]) == d)
        out.append((
            min(convs), d, min(members[node[:-1]]) if d else None, len(convs), sum(1 for m in members if len(m) == d + 1 and m[:d] == node),
            len(childless), sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below), sha(",".join(map(str, ends))),
        ))
    return sorted(out, key=repr)


def plain_rebuilt(conversations):
    out = {}
    for c, turns in conversations.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(c - 100 * int(c / 100))
        out[c] = turns if c == base else conversations.get(base, [])[:h] + turns[h:]
    return out


def trie_rows(df):
    return sorted((tuple(r) for r in df.select(*prefix_trie._RESULT).collect()), key=repr)


@pytest.mark.parametrize("cells", [None, 8, 64])
def test_trie_equals_a_plain_one(spark, cells):
    ship(spark)
    rnd = random.Random(cells)
    rows = []
    for conv in range(60):
        for turn in range(rnd.choice([1, 2, 3, 5])):
            role, text = rnd.choice([("user", "a"), ("user", "bé"), (None, None), ("", ""), ("assistant", "a" * 9)])
            rows.append((conv - 3, rnd.choice([turn, None, 7]), role, text, "x", 1, "y"))
    rows += [(500 + i, 0, "user", "the same", "x", 1, "y") for i in range(150)] + [(None, 1, "user", "no id", "x", 1, "y")]
    turns = prefix_trie.numbered(spark.createDataFrame(rows, TURNS))
    plain = {c: [(r, t) for _, _, r, t, _ in v] for c, v in by_conversation(rows, "").items() if c is not None}
    assert trie_rows(prefix_trie.trie(turns, cells)) == plain_trie(plain)


def test_registered_trie_equals_a_plain_one(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    plain = plain_rebuilt({c: [(r, t) for _, _, r, t, _ in v] for c, v in by_conversation(rows, "").items()})
    assert trie_rows(queries.op11_prefix_trie(spark, FOLDER)) == plain_trie(plain)


def test_turnless_conversations_end_at_the_root(spark):
    ship(spark)
    named = spark.createDataFrame([(5, 0, None, None), (3, 0, None, None)], "conv_id long, nr long, role string, text string")
    assert trie_rows(prefix_trie.trie(named)) == [(3, 0, None, 2, 0, 1, 0, sha("3,5"))]
    assert trie_rows(prefix_trie.trie(named.filter("nr > 0"))) == []


def test_a_long_conversation_and_its_copies(spark):
    ship(spark)
    rows = [(c, t, "user", "x" * (t % 7), "", 1, "") for c in (1, 2, 30) for t in range(400 + c)]
    df = prefix_trie.trie(prefix_trie.numbered(spark.createDataFrame(rows, TURNS)))
    got = {(r.conv_id, r.depth): r for r in df.collect()}
    assert len(got) == 431 and got[(1, 0)].n_leaves == 1 and got[(30, 430)].ends_sha256 == sha("30") and got[(2, 402)].n_children == 1
    assert got[(1, 0)].saved_tokens == 2 * sum(t % 7 for t in range(401)) + sum(t % 7 for t in range(401, 402))


def test_a_screen_with_room_shuffles_only_what_is_shared(spark):
    ship(spark)
    rows = [(c, t, "user", f"{c if t else ''} {t}", "", 1, "") for c in range(300) for t in range(5)]
    told = prefix_trie.screened(prefix_trie.prefixes(prefix_trie.numbered(spark.createDataFrame(rows, TURNS))))
    assert 300 * 2 <= told.filter("NOT alone").count() < 300 * 2 + 30


# --- repair ----------------------------------------------------------------------------------


def plain_edits(symbols):
    """Cheapest cost, and the ASCII-least letters of that cost, by trying states in order."""
    following, keep = (2, 2, 3, 2), {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, letters, i, state = heapq.heappop(heap)
        if i == len(symbols) and state in (0, 3):
            return cost, letters
        if (i, state) in seen:
            continue
        seen.add((i, state))
        heapq.heappush(heap, (cost + 5, letters + "I", i, following[state]))
        if i < len(symbols):
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, state))
            s = symbols[i]
            if s != "x":
                more = 5 if s.isupper() else 0
                if state in keep.get(s.lower(), {}):
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, keep[s.lower()][state]))
                heapq.heappush(heap, (cost + 1 + more, letters + "R", i + 1, following[state]))


def test_edits_equal_a_plain_search():
    rnd = random.Random(3)
    for _ in range(3000):
        letters, text = rnd.choice(["suaoxSUAO", "uaU", "uxa", "sU", "SUA"]), ""
        while len(text) < rnd.randrange(12):
            text += rnd.choice(letters) * rnd.choice([1, 1, 2, 5])
        runs = [(k, len(list(g))) for k, g in groupby(text)]
        assert repair.cheapest(runs) == plain_edits(text), text


def test_long_runs_are_carried_by_powers():
    cost, audit = repair.cheapest([("u", 3_000_001), ("x", 5), ("a", 1_000_000)])
    again = repair.cheapest([("u", 1)] * 3001 + [("x", 1)] * 5 + [("a", 1)] * 1000)
    assert len(audit) >= 4_000_006 and repair.cheapest([("u", 3001), ("x", 5), ("a", 1000)]) == again
    assert cost == sum({"D": 2, "K": 0, "R": 1, "I": 5}[k] * audit.count(k) for k in "DKRI")


def plain_damage(rows):
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
            yield from [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)


def plain_repair(rows):
    found, out = by_conversation(plain_damage(rows), " "), []
    for conv in {r[0] for r in rows}:
        seen, symbols, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        own = found.get(conv, [])
        for _, _, role, text, _ in own:
            bare = text.strip(repair.SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
            if fault:
                counts[fault] += 1
        cost, audit = plain_edits(symbols)
        left, state, lines = list(own), 0, []
        for letter in audit:
            row = None if letter == "I" else left.pop(0)
            if letter == "D":
                continue
            fitting = "assistant" if state == 2 else "user"
            role, text = (row[2], row[3]) if letter == "K" else (fitting, row[3] if row else "")
            state = 1 if role[0] == "s" else 3 if state == 2 else 2
            lines.append(f"{role}:{text}")
        turns = [t for *_, t in own if t is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines)),
        ))
    return sorted(out, key=repr)


def repair_rows(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_registered_repair_equals_a_plain_one(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repair_rows(queries.op12_repair(spark, FOLDER)) == plain_repair(rows)


def test_repair_of_odd_conversations(spark, tmp_path):
    rnd = random.Random(9)
    texts = ["Good.", "Cut off", "Also good!  \n", None, "", " \t\x0b", "Ends in \x85", "Ja?", "word " * 3000 + "."]
    rows = [
        (rnd.choice([None, *range(40)]), rnd.choice([None, *range(9)]), rnd.choice(["user", "assistant", "system", "tool", None, "", "User"]), rnd.choice(texts), "n", 1, "p")
        for _ in range(500)
    ]
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    assert repair_rows(queries.op12_repair(spark, str(tmp_path))) == plain_repair(rows)
    none = spark.createDataFrame([], TURNS)
    none.write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert repair_rows(queries.op12_repair(spark, str(tmp_path / "none"))) == []
    assert trie_rows(queries.op11_prefix_trie(spark, str(tmp_path / "none"))) == []


# --- byte-level BPE --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain_tool():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_ids_equal_those_of_the_library(spark, plain_tool):
    ship(spark)
    rnd = random.Random(2)
    # letters and numbers that libraries of other Unicode versions do not know, among them
    pieces = ["a", "Bé", " ", "  ", "\n", "\t", "\xa0", "\x85", "\x1c", "'s", "'LL", "1", "½", "<|endoftext|>", "漢字", "😀", "՘", "࢏", "\U00011de0", "ſ", "　", "-"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(20))) for _ in range(3000)]
    texts += [None, "", " ", "word " * 30_000, "y" * 20_000, "same", "same"]
    rows = [(i if i % 50 else None, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, chunk int").repartition(5)
    got = byte_bpe.decode(byte_bpe.encode(docs.cache(), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    want = sorted(((r[0], plain_tool.encode_ordinary(r[1] or "")) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == want
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for t in texts)


def test_small_chunks_give_the_same_ids(spark, plain_tool, monkeypatch):
    ship(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    cut = byte_bpe._cut_texts
    monkeypatch.setattr(byte_bpe, "_cut_texts", lambda pattern, names, buckets: cut(pattern, names, buckets, 500))
    got = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = sorted((r.doc_id, plain_tool.encode_ordinary(r.text or "")) for r in docs.collect())
    assert sorted((r.doc_id, r.ids) for r in got) == want


def test_registered_bpe(spark, plain_tool):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: plain_tool.encode_ordinary(r.text or "") for r in docs}
    want = {(r.doc_id, len(ids[r.doc_id]), sha(" ".join(map(str, ids[r.doc_id]))), sha(r.text or "")) for r in docs}
    assert {tuple(r) for r in queries.op13_byte_bpe(spark, FOLDER).collect()} == want


def test_empty_tables_and_texts(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()) == [(1, [], b""), (2, [], b"")]
    assert byte_bpe.encode(docs.filter("doc_id > 2"), RANKS, public_tokenizers.PATTERN).collect() == []
    lists = spark.createDataFrame([(1, [50, 60]), (2, None), (3, [])], "decoded int, ids array<int>")
    assert sorted((r.ids is None, bytes(r.decoded or b"")) for r in byte_bpe.decode(lists, RANKS).collect()) == [(False, b""), (False, b"S]"), (True, b"")]
