"""Benchmark passages in documents, by q-gram counts in diagonal bands and banded alignment.

Texts are compared lower-cased, with every run of other characters than letters and digits as
one space. An item of m bytes occurs in a document if some region of it is within e = ``ERRORS`` * m edits of
the item. Such a region shares at least m + 1 - q (e + 1) of the item's q-grams (q-gram lemma),
and their diagonals (place in the document less place in the item) span at most e. So:

1. all q-grams of the documents are looked up in a table of those of the benchmark,
2. places where too few of them are found for any item are left out (a cumulative count),
3. the other hits are counted by item and diagonal band; bands are 2 (e + 1) wide and overlap by
   half, so that one of them has all hits of a match,
4. bands with enough hits are verified by an alignment within the band, those of equal width together.

An item also occurs in a document that has only a part of it: each ``PASSAGE`` words in a row of a longer item are
searched in the same way, with edits and bands of their own. Their hits are those of the item that lie within them, so
passages need no q-grams of their own. A document has the place of the whole item if that is found, otherwise that of the
passage with the fewest edits (then the first), and these edits. Pieces of at most ``PIECE`` bytes of a word count as words.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` bytes, each of which goes to all tasks; the
documents are passed once for each block, whole, without a shuffle.

Defined cases: null and empty texts have no match; items with fewer than ``Q`` bytes match nothing;
equal items match alike, and equal rows too; with an empty benchmark nothing matches; of the overlapping places of an
item in a document the best (then first) is reported; other columns are kept or not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.llm.tokens import portions

Q = 8
ERRORS = 0.08
#: Bytes of benchmark texts that go to a task at once.
BLOCK_BYTES = 16 << 20
#: Characters of documents that are worked on at once.
AT_ONCE = 1 << 20
CELL = 32
#: Bytes of parts and texts that are aligned at once, about.
CELLS = 1 << 20
#: Words in a row of an item that count as its occurrence, and the most bytes of one.
PASSAGE = 13
PIECE = 24
_TABLE_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")
_PIECE = re.compile(rb"[^ ]{1,%d}" % PIECE)


#: Bytes of Latin-1 that are letters or digits; the others part words.
_KEPT = bytes(c if chr(c).isalnum() else 32 for c in range(256))


def normal(text: str) -> bytes:
    """What is compared of a text."""
    lower = text.lower()
    try:
        raw = lower.encode("latin-1")
    except UnicodeEncodeError:
        return " ".join(_WORD.findall(lower)).encode()
    words = b" ".join(raw.translate(_KEPT).split())
    return words if words.isascii() else words.decode("latin-1").encode()


def q_grams(data: bytes) -> np.ndarray:
    """The q-gram at each byte but the last Q - 1, as a number."""
    out = np.zeros(max(0, len(data) - Q + 1), np.uint64)
    for k in range(min(Q, len(out))):
        out[k::Q] = np.frombuffer(data, "<u8", len(range(k, len(out), Q)), k)
    return out


#: A part, the text to search, the most edits, the lowest diagonal (place in the text less place in the part) and the number of diagonals.
Band = tuple[bytes, bytes, int, int, int]
#: Fewest edits, and where that place begins and ends.
Place = tuple[int, int, int]


def exact(band: Band) -> Place | None:
    """The first place in the band without an edit."""
    item, text, _, low, width = band
    found = text.find(item, max(0, low), max(0, min(len(text), low + len(item) + width)))
    return (0, found, found + len(item)) if found >= 0 else None


def align(bands: list[Band]) -> list[Place | None]:
    """For each band the place with the fewest edits on its diagonals, None if it needs more than it may.

    Bands of equal width advance together, a byte of their parts at a time; those with too many edits drop out.
    """
    out: list[Place | None] = [None] * len(bands)
    alike: dict[int, list[int]] = {}
    for k, (item, text, _, low, width) in enumerate(bands):
        if max(0, low) < min(len(text), low + len(item) + width):
            alike.setdefault(width, []).append(k)
    for width, own in alike.items():
        step = max(1, CELLS // (width + max(len(bands[k][0]) for k in own)))
        for i in range(0, len(own), step):
            _align(bands, np.array(own[i : i + step]), width, out)
    return out


def _align(bands: list[Band], own: np.ndarray, width: int, out: list[Place | None]) -> None:
    far = np.int32(1 << 20)
    sizes = np.array([len(bands[k][0]) for k in own])
    longest = int(sizes.max())
    items, chars = np.zeros((len(own), longest), np.int16), np.full((len(own), longest + width), -1, np.int16)
    for j, k in enumerate(own.tolist()):
        item, text, _, low, _ = bands[k]
        first, last = max(0, low), min(len(text), low + len(item) + width)
        items[j, : len(item)] = np.frombuffer(item, np.uint8)
        chars[j, first - low : last - low] = np.frombuffer(text, np.uint8, last - first, first)
    budget, lows, ends = (np.array(x) for x in zip(*((bands[k][2], bands[k][3], len(bands[k][1])) for k in own)))
    steps = np.arange(width, dtype=np.int32)
    # The column of diagonal d in row i is text place low + i + d - 1; -1 lies outside of the text.
    begin = lows[:, None] + steps
    cost = np.where((begin < 0) | (begin > ends[:, None]), far, np.int32(0))
    for i in range(longest):
        here = chars[:, i : i + width]
        cross = cost + (here != items[:, i : i + 1]) + np.where(here < 0, far, np.int32(0))
        skip = np.full_like(cost, far + 1)
        skip[:, :-1] = cost[:, 1:] + 1
        start = begin.copy()
        start[:, :-1] = np.where(skip[:, :-1] < cross[:, :-1], begin[:, 1:], begin[:, :-1])
        lowered = np.minimum(cross, skip) - steps
        run = np.minimum.accumulate(lowered, axis=1)
        source = np.maximum.accumulate(np.where(lowered == run, steps, 0), axis=1)
        cost, begin = np.minimum(run + steps, far), np.take_along_axis(start, source, 1)
        alive = cost.min(axis=1) <= budget
        done = alive & (sizes == i + 1)
        for j in np.flatnonzero(done).tolist():
            d, low = int(cost[j].argmin()), int(lows[j])
            out[own[j]] = int(cost[j, d]), int(begin[j, d]), min(int(ends[j]), low + i + 1 + d)
        alive &= ~done
        if not alive.any():
            return
        if 4 * alive.sum() < 3 * len(alive):
            own, sizes, items, chars, budget, lows, ends, cost, begin = (
                x[alive] for x in (own, sizes, items, chars, budget, lows, ends, cost, begin)
            )


class Index:
    """The q-grams of benchmark items; what is searched are the items, and then their passages if these are wanted."""

    def __init__(self, items: list[str], *, passages: bool = False):
        self.items = [normal(t) for t in items]
        parts = [(i, a, z) for i, t in enumerate(self.items) for a, z in _passages(t)] if passages else []
        own = np.array(parts, np.int64).reshape(-1, 3)
        lengths = np.array([len(t) for t in self.items], np.int64)
        n = len(lengths)
        self.item_of = np.concatenate([np.arange(n), own[:, 0]])
        self.begin = np.concatenate([np.zeros(n, np.int64), own[:, 1]])
        sizes = np.concatenate([lengths, own[:, 2] - own[:, 1]])
        self._longest = int(lengths.max(initial=0)) + 1
        self._firsts, self._lasts = own[:, 0] * self._longest + own[:, 1], own[:, 0] * self._longest + own[:, 2]
        self.budget = np.minimum((ERRORS * sizes).astype(np.int64), np.maximum((sizes + 1 - Q // 2) // Q - 1, 0))
        self.least = np.maximum(sizes + 1 - Q * (self.budget + 1), 1)
        self._ends = self.begin + sizes
        # For each item: half the width of its passages' widest bands, and the hits that any of them needs.
        self._half, self._fewest = np.ones(n, np.int64), np.full(n, 1 << 40)
        np.maximum.at(self._half, own[:, 0], self.budget[n:] + 1)
        np.minimum.at(self._fewest, own[:, 0], self.least[n:])
        grams = [q_grams(t) for t in self.items]
        of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        flat = np.concatenate([np.zeros(0, np.uint64), *grams])
        order = np.argsort(flat, kind="stable")
        self._of, self._at = of[order], at[order]
        self._grams, starts = np.unique(flat[order], return_index=True)
        self._starts = np.append(starts, len(flat))
        self._table = np.zeros(1 << _TABLE_BITS, bool)
        self._table[self._slot(self._grams)] = True
        # For some classes of length: the hits that any item or passage of it needs, within so many cells.
        self._classes = []
        usable = sizes >= Q
        for bits in np.unique(np.log2(sizes[usable]).round(1)) if usable.any() else []:
            own = usable & (np.log2(np.maximum(sizes, 1)).round(1) == bits)
            reach = int((sizes[own] + 2 * self.budget[own]).max())
            self._classes.append((int(self.least[own].min()), reach // CELL + 2))

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * _MIX) >> np.uint64(64 - _TABLE_BITS)

    def _hits(self, data: bytes) -> np.ndarray:
        """Places of q-grams of the benchmark, where any item may have enough of them."""
        found = np.zeros(max(0, len(data) - Q + 1), bool)
        for k in range(min(Q, len(found))):
            grams = np.frombuffer(data, "<u8", len(range(k, len(found), Q)), k)
            found[k::Q] = self._table[self._slot(grams)]
        places = np.flatnonzero(found)
        cells = np.bincount(places // CELL, minlength=len(data) // CELL + 1)
        total = np.concatenate([[0], np.cumsum(cells)])
        enough = np.zeros(len(cells) + 1, np.int64)
        for least, reach in self._classes:
            first = np.arange(len(cells))
            last = np.minimum(first + reach, len(cells))
            rich = np.flatnonzero(total[last] - total[first] >= least)
            np.add.at(enough, rich, 1)
            np.add.at(enough, last[rich], -1)
        return places[np.cumsum(enough)[places // CELL] > 0]

    def part(self, i: int) -> bytes:
        """What is searched as number ``i``."""
        return self.items[self.item_of[i]][self.begin[i] : self._ends[i]]

    def _with_passages(self, item: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part, diagonal) of hits: in the item and in each passage of it that has the q-gram."""
        items, diagonals = item, place - at
        if not len(self._firsts):
            return items, diagonals
        # Hits in bands of the item, as wide as its widest passage needs, that are too few for any passage go first.
        half, span = self._half[item], np.int64(1) << 40
        keys = item * span + diagonals // half + (span >> 1)
        own, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
        beside = np.append(np.where(np.diff(own) == 1, counts[1:], 0), 0) + counts
        before = np.append(0, beside[:-1]) * np.append(False, np.diff(own) == 1)
        rich = np.maximum(beside, before)[which] >= self._fewest[item]
        item, at, place = item[rich], at[rich], place[rich]
        begin = item * self._longest + at
        low = np.searchsorted(self._lasts, begin + Q, "left")
        many = np.maximum(np.searchsorted(self._firsts, begin, "right") - low, 0)
        passage = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum())) + len(self.items)
        diagonal = np.repeat(place - at, many) + self.begin[passage]
        return np.concatenate([items, passage]), np.concatenate([diagonals, diagonal])

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, begin, end) of each match; places are characters of the given text."""
        plain = [normal(t) for t in texts]
        gap = b"\0" * Q
        data = gap.join(plain) + gap
        sizes = np.array([len(p) + Q for p in plain], np.int64)
        begins = np.cumsum(sizes) - sizes
        places = self._hits(data)
        if not len(places):
            return []
        grams = np.zeros(len(places), np.uint64)
        raw = np.frombuffer(data, np.uint8)
        for k in range(Q):
            grams |= raw[places + k].astype(np.uint64) << np.uint64(8 * k)
        row = np.searchsorted(self._grams, grams)
        real = (row < len(self._grams)) & (self._grams[np.minimum(row, len(self._grams) - 1)] == grams)
        places, row = places[real], row[real]
        many = self._starts[row + 1] - self._starts[row]
        source = np.repeat(self._starts[row] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        item, diagonal = self._with_passages(self._of[source], self._at[source], np.repeat(places, many))
        half = self.budget[item] + 1
        band = diagonal // half
        span = np.int64(len(data) + 2)
        keys = np.concatenate([item * 2 * span + band + span, item * 2 * span + band - 1 + span])
        keys, counts = np.unique(keys, return_counts=True)
        item, band = keys // (2 * span), keys % (2 * span) - span
        rich = counts >= self.least[item]
        item, band = item[rich], band[rich]
        best: dict[tuple[int, int], Place] = {}
        self._verify(item, band, item < len(self.items), plain, begins, best, set())
        self._verify(item, band, item >= len(self.items), plain, begins, best, set(best))
        return [(d, i, edits, *_original(texts[d], a, z)) for (d, i), (edits, a, z) in sorted(best.items())]


    def _verify(
        self, item: np.ndarray, band: np.ndarray, wanted: np.ndarray, plain: list[bytes], begins: np.ndarray,
        best: dict[tuple[int, int], Place], whole: set[tuple[int, int]],
    ) -> None:
        """Put the best place of each text and item into ``best``, from the wanted bands of texts that don't hold the ``whole`` item."""
        where, bands = [], []

        def found(key: tuple[int, int], place: Place) -> None:
            if key not in best or place < best[key]:
                best[key] = place

        item, band = item[wanted], band[wanted]
        halves = self.budget[item] + 1
        middles = band * halves + halves + (self._ends[item] - self.begin[item]) // 2
        docs = np.searchsorted(begins, middles, "right") - 1
        for i, b, half, middle, doc in zip(*(x.tolist() for x in (item, band, halves, middles, docs))):
            part, own = self.part(i), int(self.item_of[i])
            for d in {doc, *([doc - 1] if doc > 0 and middle - begins[doc] < 2 * half else []), *([doc + 1] if doc + 1 < len(plain) else [])}:
                if d < 0 or (d, own) in whole:
                    continue
                low = b * half - int(begins[d])
                if low > len(plain[d]) or low + 2 * half + len(part) < 0:
                    continue
                if best.get((d, own), (1,))[0] == 0 and best[d, own][1] <= low:
                    continue  # what begins later is no better
                one = (part, plain[d], half - 1, low, 2 * half)
                place = exact(one)
                if place:
                    found((d, own), place)
                else:
                    where.append((d, own))
                    bands.append(one)
        for key, place in zip(where, align(bands)):
            if place:
                found(key, place)


def _passages(item: bytes) -> list[tuple[int, int]]:
    """Begin and end of each ``PASSAGE`` words in a row, of an item that has more."""
    words = [m.span() for m in _PIECE.finditer(item)]
    if len(words) <= PASSAGE:
        return []
    return [(a, z) for (a, _), (_, z) in zip(words, words[PASSAGE - 1 :]) if z - a >= Q]


def _original(text: str, begin: int, end: int) -> tuple[int, int]:
    """Where bytes ``begin`` to ``end`` of the normal form lie in the text, by whole words."""
    at, lower = 0, text.lower()
    if len(lower) != len(text):  # a few capitals have longer small forms
        return 0, len(text)
    first, last = None, 0
    for m in _WORD.finditer(lower):
        size = len(m.group().encode())
        if at + size > begin and first is None:
            first = m.start()
        if at >= end:
            break
        last = m.end()
        at += size + 1
    return first or 0, last


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of all items, at most about ``BLOCK_BYTES`` bytes of texts at a time."""
    rows = benchmark.select(F.col(id_col), F.col(text_col)).filter(F.col(text_col).isNotNull())
    total = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = total // BLOCK_BYTES + 1
    for k in range(n):
        own = rows if n == 1 else rows.filter(F.pmod(F.xxhash64(text_col), F.lit(n)) == k)
        got = own.collect()  # bounded by BLOCK_BYTES
        yield [r[0] for r in got], [r[1] for r in got]


def matches(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, edits, begin, end): every document and item of it or of which it has a passage, with the place in the text."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType),
        *(T.StructField(c, T.LongType()) for c in ("edits", "begin", "end")),
    ])
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    parts = []
    for ids, items in _blocks(benchmark, item_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast((ids, items))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, index = pa.array(held.value[0]), Index(held.value[1], passages=True)
            for batch in batches:
                for first, some in portions(batch.column(1), AT_ONCE):
                    found = np.array(index.find(some), np.int64).reshape(-1, 5)
                    if len(found):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(found[:, 0] + first)), names.take(pa.array(found[:, 1])),
                             *(pa.array(found[:, k]) for k in (2, 3, 4))],
                            schema.names,
                        )

        parts.append(texts.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The documents in which no item of the benchmark and no passage of one occurs."""
    place = docs.columns.index(text_col)
    for _, items in _blocks(benchmark, item_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Index(held.value, passages=True)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, some in portions(batch.column(place), AT_ONCE):
                    clean[[first + m[0] for m in index.find(some)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
