"""Packing documents into training sequences by best-fit decreasing.

``encode_pieces`` turns documents into pieces: an overlong document is cut into full
windows, and what is left of each document (often all of it) is one piece. ``pack``
places them: a full window is a sequence of its own, the others are taken from long to
short and each goes into the open sequence with the least sufficient room, which a segment
tree over the room finds in about ten steps.

Packing is done task by task over blocks of at most ``block_rows`` pieces and
``block_bytes`` bytes of ids, so nothing is shuffled, memory is bounded whatever a
partition holds, and a lost task is repeated alone. A block leaves a few sequences
partly filled, which is little beside its thousands of full ones.

Defined cases: a null text is empty and still has its end id; equal rows are packed
separately; a null ``doc_id`` is kept as null; an empty table gives no row; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.llm.tokens import binary_column, encoder, with_end

CAPACITY = 1024
END_ID = 0
BLOCK_ROWS = 32_768
BLOCK_BYTES = 32 << 20


class RoomTree:
    """Open sequences by remaining room: a segment tree tells which rooms are in use."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._used = [0] * (2 * self._leaves)
        self._open: list[list] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence) -> None:
        self._open[room].append(sequence)
        node = room + self._leaves
        while node:
            self._used[node] += 1
            node >>= 1

    def take(self, need: int):
        """Remove and return (room, sequence) of the least room that suffices, or None."""
        used, node = self._used, need + self._leaves
        while not used[node]:
            while node & 1:  # a right child: what follows lies under the parent's sibling
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self._leaves:
            node = 2 * node if used[2 * node] else 2 * node + 1
        room = node - self._leaves
        while node:
            used[node] -= 1
            node >>= 1
        return room, self._open[room].pop()


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences.

    Longest first, equal lengths in the given order; pieces of length zero share a sequence.
    """
    tree, n = RoomTree(capacity), 0
    sequence = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found, n = (capacity, n), n + 1
        room, s = found
        sequence[i], offset[i] = s, capacity - room
        tree.add(room - need, s)
    return sequence, offset, n


Batches = Iterator[pa.RecordBatch]


def _piece_schema(docs: DataFrame, id_col: str) -> T.StructType:
    return T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
    ])


def _packed_schema(pieces: T.StructType) -> T.StructType:
    return T.StructType([
        *pieces.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
        T.StructField("padded_length", T.LongType()),
    ])


def _cutter(tokenizer: str, end_id: int, capacity: int, names: list[str]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        tool = encoder(tokenizer)
        for batch in batches:
            for first, end, ids, bounds in tool.parts(batch.column(1)):
                ids, bounds = with_end(ids, bounds, end_id)
                tokens = np.diff(bounds)
                pieces = -(-tokens // capacity)
                doc = np.repeat(np.arange(len(tokens)), pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * capacity
                length = np.minimum(capacity, tokens[doc] - start)
                cuts = np.append(bounds[doc] + start, bounds[-1])
                of = batch.column(0)[first:end].take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [of, pa.array(start), pa.array(length), binary_column(ids, cuts), pa.array(tokens[doc])], names
                )

    return run


def _place(block: list[pa.RecordBatch], capacity: int, first: int) -> tuple[pa.Table, int]:
    table = pa.Table.from_batches(block)
    length = table.column("length").to_numpy()
    full = length >= capacity
    sequence = np.zeros(len(length), np.int64)
    offset = np.zeros(len(length), np.int64)
    sequence[~full], offset[~full], n = best_fit(length[~full], capacity)
    sequence[full] = n + np.arange(full.sum())
    n += int(full.sum())
    filled = np.zeros(n, np.int64)
    np.add.at(filled, sequence, length)
    padded = np.where((filled > 0) & (filled & (filled - 1) == 0), filled, capacity)
    for name, values in (("sequence_id", sequence + first), ("offset", offset), ("padded_length", padded[sequence])):
        table = table.append_column(name, pa.array(values))
    return table, first + n


def _packer(capacity: int, block_rows: int, block_bytes: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        first = TaskContext.get().partitionId() << 40
        block: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            block.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= block_rows or size >= block_bytes:
                table, first = _place(block, capacity, first)
                yield from table.to_batches(max_chunksize=8192)
                block, rows, size = [], 0, 0
        if rows:
            yield from _place(block, capacity, first)[0].to_batches(max_chunksize=8192)

    return run


def encode_pieces(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, capacity: int = CAPACITY,
) -> DataFrame:
    """(id, start, length, ids, doc_tokens): the pieces of each document.

    ``ids`` holds little-endian unsigned 32-bit ids; ``start`` counts the document's ids
    before the piece; ``doc_tokens`` is the document's number of ids with its end id.
    """
    schema = _piece_schema(docs, id_col)
    cut = _cutter(tokenizer, end_id, capacity, schema.names)
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(cut, schema)


def pack(
    pieces: DataFrame, *, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Add ``sequence_id``, ``offset`` and ``padded_length`` to pieces of at most ``capacity`` ids.

    A sequence is padded to ``capacity``, or not at all where its length is a power of two.
    Sequence numbers are unique over the table; they are not consecutive across tasks.
    """
    return pieces.mapInArrow(_packer(capacity, block_rows, block_bytes), _packed_schema(pieces.schema))


def pack_documents(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
    capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``encode_pieces`` and ``pack`` in one step of each task."""
    schema = _piece_schema(docs, id_col)
    cut, packer = _cutter(tokenizer, end_id, capacity, schema.names), _packer(capacity, block_rows, block_bytes)
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return texts.mapInArrow(lambda batches: packer(cut(batches)), _packed_schema(schema))


def sequences(packed: DataFrame, *, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): the padded training sequences of packed pieces."""
    whole = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.max("padded_length").alias("padded_length"),
        F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"),
    )
    joined = F.aggregate("parts", F.lit(b""), lambda out, part: F.concat(out, part["ids"]))
    missing = (F.col("padded_length") - F.col("n_tokens")).cast("int")
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), missing))
    return whole.select("sequence_id", "n_tokens", F.concat(joined, pad).alias("ids"))
