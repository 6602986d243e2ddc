"""Byte-level BPE by ranks: ids of whole texts and back, each distinct word merged once.

A text is cut into words by the vocabulary's expression. Each task numbers the distinct words that it
meets (a *chunk* ends after ``CHUNK_DISTINCT`` of them or ``CHUNK_WORDS`` words) and writes a document as
the numbers of its words, in order. Of these only the chunk's distinct words are shuffled by word:
all chunks that have a word meet in one task, which merges it once and joins its ids back to the chunks.
A second shuffle brings ids and documents of a chunk together, where each document is put together
by position. A chunk sends a word once, so no word is hot, however frequent it is; a chunk's rows are bounded.
Words travel in blocks of one chunk and one *bucket* (a checksum of the word), compressed, as rows of single words would take
three times the room. A bucket's distinct words are held by one task: there are ``BUCKETS`` buckets for each shuffle partition.

Documents and words of a chunk come from one exchange that both branches read (Spark reuses it). A lost
executor's part of it is worked out again from its input, so the input must be a table, not rows in an order that changes.

``decode`` joins ids with the vocabulary's bytes, a table as large as the vocabulary, a batch at a time.

Letters, numbers and white space are those that the tiktoken library knows, asked from it, since libraries differ in new characters.

Defined cases: a null text is empty; an empty one has no ids and is a row; very long texts are one row of numbers (four bytes
a word before compression) and only their distinct words are held as strings; repeated rows, also of one id, are rows of
their own; an empty table gives no row; of other columns none is read, whatever their names; a null id or an id without bytes fails in ``decode``.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.tokens import portions

#: A chunk ends when it has so many distinct words, or so many words.
CHUNK_DISTINCT = 1 << 19
CHUNK_WORDS = 1 << 22
#: Characters that are cut at once.
AT_ONCE = 1 << 20
#: Documents, or their ids, that are put together before they are handed on.
ROWS_AT_ONCE = 20_000
IDS_AT_ONCE = 1 << 21
#: Buckets of words for each shuffle partition.
BUCKETS = 16


# --- the cut ---------------------------------------------------------------------------------


def _every_character() -> str:
    return "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))


def _ranges(chars: str) -> str:
    """Characters in ascending order as the inside of a class."""
    codes = np.array([ord(c) for c in chars])
    first = np.concatenate([[True], np.diff(codes) > 1])
    last = np.concatenate([np.diff(codes) > 1, [True]])
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in zip(codes[first], codes[last]))


class _Cut:
    """Words of a text by an expression, as the tiktoken library finds them."""

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        every, single = _every_character(), {bytes([i]): i for i in range(256)}
        inside, differ = {}, set()
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            tool = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
            known = bytes(tool.encode_ordinary(every)).decode()
            inside[name] = _ranges(known)
            differ ^= set(known) ^ set(regex.findall(name, every))
        self._usual = regex.compile(pattern).findall
        self._differ = re.compile(f"[{_ranges(''.join(sorted(differ)))}]").search if differ else lambda text: None
        self._exact = re.compile(_spelled_out(pattern, inside)).findall

    def __call__(self, text: str) -> list[str]:
        return self._exact(text) if self._differ(text) else self._usual(text)


def _spelled_out(pattern: str, inside: dict[str, str]) -> str:
    """``pattern`` with its classes as ranges."""
    name = r"\\p\{[LN]\}|\\[sS]"

    def shown(m: re.Match) -> str:
        if m[0][0] == "[":
            return re.sub(name, lambda n: inside[n[0]], m[0])
        return f"[^{inside[r'\s']}]" if m[0] == r"\S" else f"[{inside[m[0]]}]"

    return re.sub(rf"\[(?:\\.|[^\]\\])*\]|{name}", shown, pattern)


@lru_cache(maxsize=2)
def _cutter(pattern: str) -> _Cut:
    return _Cut(pattern)


class _Numbers(dict):
    """Words by number, in the order met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers by planes of bytes, which compress better than numbers do."""
    import zstandard

    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _cut_texts(
    pattern: str, names: list[str], buckets: int, most: int = CHUNK_DISTINCT
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From documents to rows of (chunk, bucket, doc_id, numbers, sizes, data).

    A document has the numbers of its words and nothing else; a block of words has the steps from number to number, and
    the size and the bytes of each word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, numbers, held = _cutter(pattern), _Numbers(), 0
        chunk = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for first, texts in portions(batch.column(1), AT_ONCE):
                words = [cut(t) for t in texts]
                ends = np.cumsum([0, *map(len, words)])
                codes = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.uint32, int(ends[-1]))
                rows = [_packed(codes[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(pa.scalar(chunk, pa.int64()), n), pa.nulls(n, pa.int64()), batch.column(0).slice(first, n),
                    pa.array(rows, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
                ], names)
                held += int(ends[-1])
                if held >= CHUNK_WORDS or len(numbers) >= most:
                    yield _word_blocks(numbers, chunk, buckets, doc_type, names)
                    numbers, held, chunk = _Numbers(), 0, chunk + 1
        if numbers:
            yield _word_blocks(numbers, chunk, buckets, doc_type, names)

    return run


def _word_blocks(numbers: _Numbers, chunk: int, buckets: int, doc_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    """The distinct words of a chunk, one row for each bucket."""
    import zstandard

    words = [w.encode() for w in numbers]
    bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets
    order = np.argsort(bucket, kind="stable")
    own, starts = np.unique(bucket[order], return_index=True)
    columns = [], [], []
    for some in np.split(order, starts[1:]):
        texts = [words[i] for i in some.tolist()]
        for column, data in zip(columns, (
            _packed(np.diff(some, prepend=0)), _packed(np.fromiter(map(len, texts), np.uint32, len(texts))), zstandard.compress(b"".join(texts), 1),
        )):
            column.append(data)
    n = len(own)
    return pa.RecordBatch.from_arrays([
        pa.repeat(pa.scalar(chunk, pa.int64()), n), pa.array(own, pa.int64()), pa.nulls(n, doc_type), *[pa.array(c, pa.binary()) for c in columns],
    ], names)


def _only_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of words. A filter would be pushed below the exchange, which then could not be shared."""
    for batch in batches:
        words = batch.select(["chunk", "bucket", "numbers", "sizes", "data"]).filter(pc.is_valid(batch.column("bucket")))
        if len(words):
            yield words


# --- each distinct word once -----------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: bytes of each token, and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _merger(path: str) -> Callable[[str], list[int]]:
    import tiktoken

    # the whole word is one match
    tool = tiktoken.Encoding("word", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={})
    return tool.encode_ordinary


class _Merged(dict):
    """Words with their ids as bytes; a word that is asked for the first time is merged."""

    def __init__(self, merge: Callable[[str], list[int]]):
        self._merge = merge

    def __missing__(self, word: bytes) -> bytes:
        self[word] = ids = np.array(self._merge(word.decode()), "<u4").tobytes()
        return ids


def _merge_words(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(chunk, numbers, sizes, ids) from the blocks of words, in the order of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        merge, now, known = _merger(path), None, None
        for batch in batches:
            out = []
            for bucket, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sizes", "data"))):
                if bucket != now:
                    now, known = bucket, _Merged(merge)
                text, ends = zstandard.decompress(data), np.cumsum(_unpacked(sizes)).tolist()
                ids = [known[text[a:b]] for a, b in zip([0, *ends], ends)]
                out.append((_packed(np.fromiter(map(len, ids), np.uint32, len(ids)) // 4), _packed(np.frombuffer(b"".join(ids), "<u4"))))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chunk"), batch.column("numbers"), *[pa.array(c, pa.binary()) for c in zip(*out)]], ["chunk", "numbers", "sizes", "ids"]
                )

    return run


# --- documents by position -------------------------------------------------------------------


def _reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """(doc_id, ids) of a chunk: its documents as numbers, and the ids of each number."""
    docs = left.filter(pc.is_null(left.column("bucket")))
    nothing = np.zeros(0, np.uint32)
    number = np.concatenate([nothing, *[np.cumsum(_unpacked(x.as_buffer())) for x in right.column("numbers")]]).astype(np.int64)
    sizes = np.concatenate([nothing, *[_unpacked(x.as_buffer()) for x in right.column("sizes")]]).astype(np.int64)
    store = np.concatenate([nothing, *[_unpacked(x.as_buffer()) for x in right.column("ids")]])
    begins, lengths = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    begins[number], lengths[number] = np.cumsum(sizes) - sizes, sizes
    out, some, bounds, first = [], [], [0], 0

    def batch(last: int) -> pa.RecordBatch:
        doc_ids = docs.column("doc_id").slice(first, last - first).combine_chunks()
        values = pa.array(np.concatenate([nothing, *some]).astype(np.int32))
        return pa.RecordBatch.from_arrays([_one(doc_ids), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)], ["doc_id", "ids"])

    for i, data in enumerate(docs.column("numbers")):
        codes = _unpacked(data.as_buffer())
        size = lengths[codes]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        some.append(store[np.repeat(begins[codes] - stop + size, size) + np.arange(total)])
        bounds.append(bounds[-1] + total)
        if bounds[-1] >= IDS_AT_ONCE or len(some) >= ROWS_AT_ONCE:
            out.append(batch(i + 1))
            some, bounds, first = [], [0], i + 1
    out.append(batch(docs.num_rows))
    return pa.Table.from_batches(out)


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def encode(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every document, by the ranks at ``path`` and words cut by ``pattern``.

    ``ids`` is an array of int. ``path`` must be there on every machine.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "bucket", "doc_id", "numbers", "sizes", "data"]
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.mapInArrow(
        _cut_texts(pattern, names, buckets), f"chunk long, bucket long, doc_id {kind}, numbers binary, sizes binary, data binary"
    )
    dealt = cut.repartition("chunk")
    words = dealt.mapInArrow(_only_words, "chunk long, bucket long, numbers binary, sizes binary, data binary")
    by_word = words.repartition("bucket").sortWithinPartitions("bucket")
    ids = by_word.mapInArrow(_merge_words(path), "chunk long, numbers binary, sizes binary, ids binary")
    together = dealt.groupBy("chunk").cogroup(ids.groupBy("chunk"))
    return together.applyInArrow(_reassemble, f"doc_id {kind}, ids array<int>")


# --- and back --------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> pa.Array:
    ranks = read_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())


def decode(encoded: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """``encoded`` with the bytes of its ids as ``decoded`` (an earlier column of that name goes); null ids have none."""
    kept = encoded.drop("decoded")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(path)
        for batch in batches:
            lists = batch.column(names.index(ids))
            tokens = table.take(lists.flatten())
            if tokens.null_count:
                raise ValueError("an id has no bytes in this vocabulary")
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            place = np.concatenate([[0], np.cumsum(size)])
            data_ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(tokens), np.int64))])
            joined = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(lists), [None, pa.py_buffer(data_ends[place]), pa.py_buffer(b"".join(_data(tokens)))]
            ).cast(pa.binary())
            joined = pc.if_else(pc.is_valid(lists), joined, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, joined], [*names, "decoded"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, decoded binary")


def _data(tokens: pa.Array) -> list[memoryview]:
    """The bytes of a binary array, one after another."""
    offsets = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
    return [memoryview(tokens.buffers()[2])[offsets[0] : offsets[-1]]] if len(tokens) else []
