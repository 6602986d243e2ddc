"""Token ids in a compact file format: canonical length-limited Huffman codes.

A store is one file per range of documents, all with the same code:

    magic, version, vocabulary size, longest code; one length byte per id (the code is
    canonical, so the lengths tell it); blocks; the index; its place and magic again.

A block holds ``BLOCK_IDS`` ids (the last of a file fewer) and can be read alone: the
number of ids, one bit offset per ``LANE`` ids (the checkpoints), then the bits. Decoding
looks up ``longest code`` bits at a time in a table; all lanes of a block advance together,
one numpy step for each of the ``LANE`` ids.

Counting, coding and reading run as Spark tasks. The only thing on the driver is the count
of each id, whose number is the size of the vocabulary. Files get fresh names, and a table
beside them lists those of finished tasks, so repeated or lost tasks leave nothing
that a reader sees.

Defined cases: a null text is empty and has its end id; null ``doc_id`` come first; equal
``doc_id`` are ordered by length and checksum; an empty table gives an empty store; other
columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.storage import materialize, scratch
from pagesieve.llm.files import open_for_reading, open_for_writing, read_tasks
from pagesieve.llm.tokens import binary_column, encoder, with_end

MAGIC = b"HUFTOK01"
MAX_BITS = 20
BLOCK_IDS = 1 << 16
LANE = 64
END_ID = 1
#: Stands for a null name in a file.
NO_NAME = -(1 << 63)
#: Ids that a task reads, about.
TASK_IDS = 32 << 20


# --- the code --------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of a best prefix code with at most ``max_bits`` bits (package-merge).

    Ids that do not occur have length zero. A single id has length one.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    # In each round the coins are the ids and the pairs of the round before. A coin is known by
    # its rank in its round; how many ids are among the first k coins is all that is needed.
    ids_among: list[np.ndarray] = []
    level = weights
    is_id = np.ones(n, bool)
    for _ in range(max_bits - 1):
        ids_among.append(np.concatenate([[0], np.cumsum(is_id)]))
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        level, is_id = both[rank], rank < n
    ids_among.append(np.concatenate([[0], np.cumsum(is_id)]))
    take, depth = 2 * n - 2, np.zeros(n + 1, np.int64)
    for among in reversed(ids_among):
        ids = int(among[take])
        depth[0] += 1
        depth[ids] -= 1  # the lightest ``ids`` ids become one bit longer
        take = 2 * (take - ids)
    lengths[order] = np.cumsum(depth)[:n]
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id), each one more than the one before."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    code = last = 0
    for i in order.tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def lookup_table(lengths: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for every value of the next ``max_bits`` bits."""
    codes, used = canonical(lengths), np.flatnonzero(lengths)
    order = used[np.argsort(codes[used] << (max_bits - lengths[used]).astype(np.uint64), kind="stable")]
    span = 1 << (max_bits - lengths[order].astype(np.int64))
    rest = (1 << max_bits) - int(span.sum())
    return (
        np.concatenate([np.repeat(order, span), np.zeros(rest, np.int64)]).astype(np.uint32),
        np.concatenate([np.repeat(lengths[order], span), np.zeros(rest, np.uint8)]).astype(np.uint8),
    )


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """Number of ids, checkpoints, bits."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begin = ends - size
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 32 + 3, np.uint64)
    at, inside = begin >> 5, begin & 31
    shifted = codes[ids] << (64 - inside - size).astype(np.uint64)
    if len(ids):
        heads = np.flatnonzero(np.diff(at, prepend=-1))
        words[at[heads]] += np.add.reduceat(shifted >> np.uint64(32), heads)
        words[at[heads] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), heads)
    bits = words.astype(">u4").tobytes()[: total // 8 + 1]
    marks = begin[::LANE].astype("<u4").tobytes()
    return struct.pack("<II", len(ids), len(bits)) + marks + bits


def decode_block(block: bytes, table: tuple[np.ndarray, np.ndarray], max_bits: int) -> np.ndarray:
    """The ids of a block."""
    n, n_bits = struct.unpack_from("<II", block)
    lanes = -(-n // LANE)
    at = np.frombuffer(block, "<u4", lanes, 8).astype(np.int64)
    raw = np.frombuffer(block, np.uint8, n_bits, 8 + 4 * lanes)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    ids, sizes = table
    out = np.zeros((LANE, lanes), np.uint32)
    last = len(window) - 1
    for k in range(LANE):
        next_bits = window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32) >> np.uint32(32 - max_bits)
        out[k] = ids[next_bits]
        at = at + sizes[next_bits]
    return out.T.reshape(-1)[:n]


# --- a file ----------------------------------------------------------------------------


class Writer:
    """Writes documents one after another."""

    def __init__(self, out, lengths: np.ndarray, max_bits: int):
        self._out, self._lengths, self._codes = out, lengths, canonical(lengths)
        self._place = 0
        self._left = np.zeros(0, np.uint32)
        self._blocks: list[tuple[int, int]] = []
        self._counts: list[bytes] = []
        self._names: list[bytes] = []
        self.n_ids = self.n_docs = 0
        self._put(MAGIC + struct.pack("<II", len(lengths), max_bits) + lengths.tobytes())

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self._place += len(data)

    def _block(self, ids: np.ndarray) -> None:
        data = encode_block(ids, self._codes, self._lengths)
        self._blocks.append((self._place, len(data)))
        self._put(data)

    def add(self, ids: np.ndarray, counts: np.ndarray, names: np.ndarray) -> None:
        """Documents with these numbers as names, of so many ids each."""
        self._counts.append(np.ascontiguousarray(counts, "<i8").tobytes())
        self._names.append(np.ascontiguousarray(names, "<i8").tobytes())
        self.n_docs += len(counts)
        self.n_ids += len(ids)
        pending = np.concatenate([self._left, ids])
        for i in range(0, len(pending) - BLOCK_IDS + 1, BLOCK_IDS):
            self._block(pending[i : i + BLOCK_IDS])
        self._left = pending[len(pending) // BLOCK_IDS * BLOCK_IDS :]

    def close(self) -> None:
        if len(self._left):
            self._block(self._left)
        index = struct.pack("<QQ", self.n_docs, len(self._blocks)) + b"".join(self._counts) + b"".join(self._names)
        index += np.asarray(self._blocks, "<i8").reshape(-1, 2).tobytes()
        place = self._place
        self._put(index + struct.pack("<Q", place) + MAGIC)


class Reader:
    """Reads one file; blocks can be read in any order."""

    def __init__(self, source):
        self._in = source
        size = source.size()
        place, magic = struct.unpack("<Q8s", self._at(size - 16, 16))
        head, vocabulary, self.max_bits = struct.unpack("<8sII", self._at(0, 16))
        if magic != MAGIC or head != MAGIC:
            raise ValueError("not a token file, or not complete")
        self._table = lookup_table(np.frombuffer(self._at(16, vocabulary), np.uint8), self.max_bits)
        index = self._at(place, size - 16 - place)
        n_docs, n_blocks = struct.unpack_from("<QQ", index)
        self.counts = np.frombuffer(index, "<i8", n_docs, 16)
        self.names = np.frombuffer(index, "<i8", n_docs, 16 + 8 * n_docs)
        self._blocks = np.frombuffer(index, "<i8", 2 * n_blocks, 16 + 16 * n_docs).reshape(-1, 2)
        self.n_blocks = n_blocks

    def _at(self, place: int, size: int) -> bytes:
        self._in.seek(place)
        return self._in.read(size)

    def block(self, k: int) -> np.ndarray:
        return decode_block(self._at(*map(int, self._blocks[k])), self._table, self.max_bits)

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document, in the order of the file."""
        have, k = np.zeros(0, np.uint32), 0
        for n in self.counts.tolist():
            parts, got = [have], len(have)
            while got < n:
                parts.append(self.block(k))
                got, k = got + len(parts[-1]), k + 1
            have = np.concatenate(parts)
            yield have[:n]
            have = have[n:]


# --- on Spark --------------------------------------------------------------------------


def encode_documents(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> DataFrame:
    """(doc_id, crc, n_tokens, ids): the ids of each document, its end id included.

    ``ids`` has two bytes for each id if the vocabulary allows it, else four.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        wide = tool.size > 1 << 16
        for batch in batches:
            for first, end, ids, bounds in tool.parts(batch.column(1)):
                ids, bounds = with_end(ids, bounds, end_id)
                data = ids.astype("<u4")
                crc = [zlib.crc32(data[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                kept = binary_column(data if wide else ids.astype("<u2"), bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end], pa.array(crc, pa.int64()), pa.array(np.diff(bounds)), kept],
                    ["doc_id", "crc", "n_tokens", "ids"],
                )

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id long, crc long, n_tokens long, ids binary")


def _ids(value: pa.BinaryScalar, n: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), f"<u{value.as_buffer().size // n}", n)


def count_ids(encoded: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents; as many entries as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value, n in zip(batch.column(0), batch.column(1).to_pylist()):
                seen = np.bincount(_ids(value, n))
                if len(seen) > len(total):
                    total = np.pad(total, (0, len(seen) - len(total)))
                total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counted = encoded.select("ids", "n_tokens").mapInArrow(run, "id long, n long")
    return {r["id"]: r["n"] for r in counted.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def write_store(encoded: DataFrame, folder: str, *, max_bits: int = MAX_BITS) -> DataFrame:
    """Write documents in ascending ``doc_id`` order; the table of files (part, path, n_docs, n_ids, base).

    ``encoded`` is read twice, so it should be a written table. ``base`` is the number of
    ids in all files before.
    """
    counts = count_ids(encoded)
    flat = np.zeros(max(counts, default=0) + 1, np.int64)
    flat[list(counts)] = list(counts.values())
    code = code_lengths(flat, max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        path = f"{folder}/tokens-{uuid.uuid4().hex}.bin"
        with open_for_writing(path) as out:
            writer = Writer(out, code, max_bits)
            for batch in (x for xs in ([first], batches) for x in xs):
                n = batch.column(2).to_numpy()
                ids = [_ids(v, k) for v, k in zip(batch.column(3), n.tolist())]
                names = pa.compute.fill_null(batch.column(0), NO_NAME).to_numpy()
                if ids:
                    writer.add(np.concatenate(ids), n, names)
            writer.close()
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "path": path, "n_docs": writer.n_docs, "n_ids": writer.n_ids}],
            pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    key = ["doc_id", "n_tokens", "crc"]
    files = encoded.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "crc", "n_tokens", "ids")
    written = materialize(files.mapInArrow(run, "part long, path string, n_docs long, n_ids long"), f"{folder}/files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_store(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files, decoded; ids in four bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_for_reading(path) as source:
                    reader = Reader(source)
                    starts = base + np.cumsum(reader.counts) - reader.counts
                    names = pa.array(reader.names, mask=reader.names == NO_NAME)
                    rows, held = [], 0
                    for i, ids in enumerate(reader.documents()):
                        rows.append(ids)
                        held += len(ids)
                        if held >= 1 << 20 or i == len(starts) - 1:
                            a = i + 1 - len(rows)
                            bounds = np.concatenate([[0], np.cumsum(reader.counts[a : i + 1])])
                            yield pa.RecordBatch.from_arrays(
                                [names[a : i + 1], pa.array(starts[a : i + 1]), pa.array(reader.counts[a : i + 1]),
                                 binary_column(np.concatenate(rows), bounds)],
                                ["doc_id", "start", "n_tokens", "ids"],
                            )
                            rows, held = [], 0

    tasks = read_tasks(files.sparkSession, files.agg(F.sum("n_ids")).first()[0], TASK_IDS)
    spread = files.select("path", "base").repartition(tasks, "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def store(docs: DataFrame, tokenizer: str, *, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode all documents, write a store, and return its table of files."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    path = f"{folder}/encoded"
    encode_documents(docs, tokenizer, end_id=end_id).write.option("compression", "zstd").parquet(path)
    return write_store(docs.sparkSession.read.parquet(path), folder)
