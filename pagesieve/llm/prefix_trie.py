"""Conversation prefix trie: what conversations share from their first turn on.

A node is a distinct sequence of first turns; its digest chains the digest of its parent with role and text (16 bytes of
BLAKE2b, so two sequences meet with a chance of about n * n / 2**129). All prefixes are counted in a count-min sketch of
``ROWS`` rows of cells that stop at two. An estimate of one proves a prefix a singleton: cells only count too much. Its
node, and all below it, belong to one conversation and are emitted where they are, without a shuffle. Only prefixes
that may be shared are shuffled and grouped exactly, so a false alarm costs a row and changes nothing.

Each task counts its own rows and sends the cells that it met, two bytes each; they are added up block by block and broadcast as one
bit a cell: at most ``ROWS * MAX_CELLS / 8`` bytes (64 MB), whatever the input. A row has two to four cells for each prefix up to that
size. Beyond it, more prefixes pass the screen and are grouped; the result is the same.

Sums over subtrees need no walk by depth. Nodes of one least conversation are a stretch of its path (its *branch*), so a
running sum from the end of each branch and one total for each conversation suffice: a node's sum is that of its own branch from its
depth on and the totals of all other members. Totals are reduced before each shuffle, so a prefix that a third of
all conversations share is no task's burden. The list of conversations that end at a node is cut by ranges into strings of
many ids, in parallel, and only those strings are hashed in order.

Defined cases: a null role or text is empty; turns are ordered by ``turn`` (null first), then role and text; repeated rows are turns of
their own; rows without a ``conv_id`` are no conversation; texts may be of any length, and the turns of a conversation are
streamed; an empty table gives no row, not even a root; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.skew import salted_join
from pagesieve.functions.storage import scratch
from pagesieve.llm.stages import written

DIGEST = 16
ROWS = 4
#: Cells of a row of the sketch: a power of two between these.
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 27
#: Cells that a task sorts at once.
CELLS_AT_ONCE = 1 << 22
#: Cells that are sent and added up together.
BLOCK = 1 << 16
#: Bytes of ids that are hashed at once.
IDS_AT_ONCE = 1 << 16
ROOT = b"\0" * DIGEST
_PREFIX = "conv_id long, depth long, digest binary, parent binary, chars long, is_end boolean"
_COLUMNS = ["conv_id", "depth", "digest", "parent", "chars", "is_end"]


# --- prefixes --------------------------------------------------------------------------------


def _chain(parent: bytes, role: str, text: str) -> bytes:
    r = role.encode()
    return hashlib.blake2b(b"%d:%b%b" % (len(r), r, text.encode()), digest_size=DIGEST, key=parent).digest()


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, chars, is_end): every prefix of every conversation, the empty one as depth 0.

    ``turns(conv_id, nr, role, text)`` are numbered from 1 in each conversation; a number that is 0 only names one.
    ``chars`` are the code points of the last text; ``is_end`` tells the whole conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # waits for the next row, which tells whether it ends its conversation
        for batch in batches:
            out = []
            for conv, nr, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if last is None or last[0] != conv:
                    if last:
                        out.append((*last, True))
                    last = (conv, 0, ROOT, None, 0)
                if nr:
                    out.append((*last, False))
                    last = (conv, last[1] + 1, _chain(last[2], role, text), last[2], len(text))
            if out:
                yield _prefix_rows(out)
        if last:
            yield _prefix_rows([(*last, True)])

    named = turns.filter("conv_id IS NOT NULL")
    ordered = named.select("conv_id", "nr", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "nr")
    return ordered.mapInArrow(run, _PREFIX)


def _prefix_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _COLUMNS)


# --- the sketch ------------------------------------------------------------------------------


def _cells(digests: pa.Array, n: int) -> list[np.ndarray]:
    """The cell of each digest in each row: four bytes of the digest, which are independent."""
    words = np.frombuffer(b"".join(x.as_buffer() for x in digests), "<u4").reshape(-1, DIGEST // 4)
    return [words[:, r] & np.uint32(n - 1) for r in range(ROWS)]


def _partial(n: int):
    """A task's prefixes as cells: (block, cells within it, whether each was met more than once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held += [cells.astype(np.int64) + r * n for r, cells in enumerate(_cells(batch.column(0), n))]
            size += ROWS * len(batch)
            if size >= CELLS_AT_ONCE:
                yield from _cell_rows(held, min(n, BLOCK))
                held, size = [], 0
        if size:
            yield from _cell_rows(held, min(n, BLOCK))

    return run


def _cell_rows(held: list[np.ndarray], block: int) -> Iterator[pa.RecordBatch]:
    cells, counts = np.unique(np.concatenate(held), return_counts=True)
    blocks, starts = np.unique(cells // block, return_index=True)
    within = np.split((cells % block).astype("<u2"), starts[1:])
    many = np.split(counts > 1, starts[1:])
    yield pa.RecordBatch.from_arrays(
        [pa.array(blocks), *[pa.array([x.tobytes() for x in part], pa.binary()) for part in (within, many)]], ["block", "cells", "many"]
    )


def _added(block: int):
    """One row a block: the bits of cells with a count of two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, None
        for batch in batches:
            for nr, cells, many in zip(*(c.to_pylist() for c in batch.columns)):
                if nr != now:
                    if now is not None:
                        yield _bits(now, counts)
                    now, counts = nr, np.zeros(block, np.uint8)
                at = np.frombuffer(cells, "<u2")
                counts[at] = np.minimum(counts[at] + 1 + np.frombuffer(many, np.uint8), 2)
        if now is not None:
            yield _bits(now, counts)

    return run


def _bits(nr: int, counts: np.ndarray) -> pa.RecordBatch:
    data = zlib.compress(np.packbits(counts > 1).tobytes(), 1)
    return pa.RecordBatch.from_arrays([pa.array([nr], pa.int64()), pa.array([data], pa.binary())], ["block", "data"])


def sketch(found: DataFrame, cells: int | None = None) -> tuple[bytes, int]:
    """Which cells were met at least twice, a bit each, and the cells of a row, from prefixes with ``digest``.

    At most ``ROWS * MAX_CELLS`` bits come to the driver.
    """
    digests = found.filter("depth > 0").select("digest")
    if cells is None:
        cells = min(max(MIN_CELLS, 1 << (2 * digests.count()).bit_length()), MAX_CELLS)
    block = min(cells, BLOCK)
    parts = digests.mapInArrow(_partial(cells), "block long, cells binary, many binary")
    whole = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_added(block), "block long, data binary")
    shared = np.zeros((ROWS * cells // block, block // 8), np.uint8)
    for row in whole.collect():
        shared[row.block] = np.frombuffer(zlib.decompress(bytes(row.data)), np.uint8)
    return zlib.compress(shared.tobytes(), 1), cells


def screened(found: DataFrame, cells: int | None = None) -> DataFrame:
    """``found`` with two columns more: ``alone``, whether the sketch proves the prefix or its parent a singleton, and
    ``parent_alone``, whether it proves the parent one."""
    bits, n = sketch(found, cells)
    told = found.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = np.frombuffer(zlib.decompress(told.value), np.uint8).reshape(ROWS, -1)

        def single(digests: pa.Array) -> np.ndarray:
            out = np.zeros(len(digests), bool)
            for r, cell in enumerate(_cells(digests, n)):
                out |= shared[r, cell >> 3] >> (7 - (cell & 7)) & 1 == 0
            return out

        for batch in batches:
            depth = np.asarray(batch.column("depth"))
            parent_alone = single(pc.fill_null(batch.column("parent"), ROOT)) & (depth > 1)
            alone = single(batch.column("digest")) & (depth > 0) | parent_alone
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone), pa.array(parent_alone)], [*_COLUMNS, "alone", "parent_alone"])

    return found.mapInArrow(run, f"{_PREFIX}, alone boolean, parent_alone boolean")


# --- exact groups ----------------------------------------------------------------------------


def _ends(members: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of (digest, conv_id): the hash of the ids in order, comma-joined.

    Ranges of (digest, id) are joined to strings first, so a node with very many members is hashed from few rows.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, ids, size = None, None, [], 0
        for batch in batches:
            for digest, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and (digest != now or size >= IDS_AT_ONCE):
                    yield _strings([(now, first, ",".join(ids))])
                    now = None
                if now is None:
                    now, first, ids, size = digest, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1])
        if now is not None:
            yield _strings([(now, first, ",".join(ids))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for digest, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if digest == now:
                    sha.update(b"," + ids.encode())
                else:
                    done += [(now, sha.hexdigest())] if sha else []
                    now, sha = digest, hashlib.sha256(ids.encode())
            if done:
                yield _hashes(done)
        if sha:
            yield _hashes([(now, sha.hexdigest())])

    ranges = members.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    strings = ranges.mapInArrow(joined, "digest binary, first long, ids string")
    return strings.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hashed, "digest binary, ends_sha256 string")


def _strings(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["digest", "first", "ids"])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.binary(), pa.string()])], ["digest", "ends_sha256"])


_NO_ENDS = hashlib.sha256().hexdigest()


def trie(turns: DataFrame, cells: int | None = None) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` as for ``prefixes``; ``cells`` is the size of a row of the sketch, by default from the number of prefixes.
    """
    path = scratch(turns.sparkSession, "trie")
    found = written(prefixes(turns), f"{path}/prefixes")
    told = written(screened(found, cells), f"{path}/screened")
    maybe, tails = told.filter("NOT alone"), told.filter("alone")

    # nodes of prefixes that may be shared; the root is one of them
    nodes = maybe.groupBy("digest").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
        F.min("chars").alias("chars"), F.count("*").alias("n_convs"),
    )
    heads = tails.filter("NOT parent_alone").select("parent")
    children = nodes.filter("parent IS NOT NULL").select("parent").unionByName(heads).groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = written(nodes, f"{path}/nodes")

    # what each conversation adds to every node that it is a member of: its leaf, and what its branch saves
    branch = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    own = nodes.select("digest", "conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    own = own.withColumn("saved_below", F.sum("saved").over(branch))
    adds = own.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    tail_ends = tails.filter("is_end").select("conv_id", F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaf"))
    adds = adds.unionByName(tail_ends).groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    sums = maybe.select("digest", "conv_id").join(adds, "conv_id").groupBy("digest").agg(F.sum("saved").alias("saved_all"), F.sum("leaf").alias("n_leaves"))
    of_branch = own.select("digest", "conv_id", "saved_below").join(adds.select("conv_id", F.col("saved").alias("saved_own")), "conv_id")
    sums = sums.join(of_branch.select("digest", "saved_below", "saved_own"), "digest")
    sums = sums.select("digest", "n_leaves", (F.col("saved_all") - F.col("saved_own") + F.col("saved_below")).alias("saved_tokens"))

    ends = _ends(maybe.filter("is_end"))
    shared = nodes.join(sums, "digest").join(ends, "digest", "left").select(
        "conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )
    single = tails.select(
        "conv_id", "depth", F.when(~F.col("parent_alone"), F.col("parent")).alias("parent"),
        F.lit(1).cast("long").alias("n_convs"), (~F.col("is_end")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("is_end"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"),
    )
    return _with_parents(shared, single, nodes)


_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _with_parents(shared: DataFrame, single: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with their parent's least conversation.

    The root's is one number. A parent that the sketch proves a singleton has the conversation of its child, and so has one that
    isn't among ``nodes``. Only nodes with another parent are shuffled; those under one parent are dealt over several tasks.
    """
    root = nodes.filter("depth = 0").first()
    top = F.lit(root.conv_id if root else None).cast("long")
    known = F.when(F.col("depth") == 0, F.lit(None).cast("long")).when(F.col("depth") == 1, top).otherwise(F.col("conv_id"))
    near = shared.filter("depth < 2").unionByName(single.filter("depth < 2 OR parent IS NULL"))
    below = shared.filter("depth > 1").unionByName(single.filter("depth > 1 AND parent IS NOT NULL"))
    least = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = salted_join(below, least, "parent", ["conv_id"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))
    return near.withColumn("parent_conv_id", known).select(*_RESULT).unionByName(below.select(*_RESULT))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, nr, role, text): turns numbered from 1 in the order of ``turn``; nulls are empty."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    return turns.filter("conv_id IS NOT NULL").select("conv_id", F.row_number().over(order).cast("long").alias("nr"), "role", "text")
