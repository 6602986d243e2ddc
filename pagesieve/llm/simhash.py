"""Near duplicates by 64-bit SimHash fingerprints, compared exactly in tiles.

Fingerprints that differ in at most ``RADIUS`` of 64 bits are linked, and documents get the
least ``doc_id`` of their component. No link between different fingerprints is missed:

* Equal fingerprints are reduced to one before anything is compared.
* The 64 bits are six lanes. Two fingerprints within four bits agree on at least two
  lanes, so all links lie within one of the fifteen ways to deal fingerprints by two lanes.
  This decides only which fingerprints meet; without it the number of tile pairs would
  grow with the square of the table.
* What meets is compared tile by tile with exclusive-or and bit counts. Tiles are ordered by
  population count; a pair of tiles is skipped if the counts differ by more than the radius.
* A deal with more than ``TILE_ROWS`` fingerprints is split into chunks, and each pair of chunks is
  a unit of work of its own, so neither a hot lane nor a ball of near copies fills a task.
* A unit reports a spanning forest of its links, never all pairs.

Defined cases: a null or blank text has fingerprint zero, linked like any other; a null
``doc_id`` takes part and never names a component unless all of its component are null;
equal rows are kept; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.functions.storage import materialize, scratch
from pagesieve.llm.graph import components

SHINGLE = 4
SEED = 42
RADIUS = 4
LANES = (11, 11, 11, 11, 10, 10)
TILE_ROWS = 4096
TILE = 512
#: Runs up to this size are compared by shifting, many runs at once.
SHORT = 24
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """Eight bytes, most significant first; of the lower-cased (A-Z) words' shingles."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, n, _SHINGLES_AT_ONCE):
        part = zip(starts[i : i + _SHINGLES_AT_ONCE], ends[i : i + _SHINGLES_AT_ONCE])
        hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in part]), np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each document as a signed long."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"")
            data = b"".join(fingerprint(t.as_py(), shingle) for t in texts)
            fp = np.frombuffer(data, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], [id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


# --- comparison of what meets ------------------------------------------------------------


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the sets of a[i] and b[i]; ``parent`` holds the root of each element."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        ra, rb = ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def forest(fp: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within ``radius`` connect.

    With two sides, only fingerprints of different sides are compared.
    """
    ones = np.bitwise_count(fp)
    order = np.lexsort((fp, ones, side))
    fp, ones, side = fp[order], ones[order], side[order]
    parent = np.arange(len(fp))
    cut = int(np.searchsorted(side, side[-1])) if side[0] != side[-1] else 0
    left, right = ((0, cut), (cut, len(fp))) if cut else ((0, len(fp)), (0, len(fp)))
    for i in range(left[0], left[1], TILE):
        i_end = min(i + TILE, left[1])
        for j in range(right[0] if cut else i, right[1], TILE):
            j_end = min(j + TILE, right[1])
            if int(ones[j]) - int(ones[i_end - 1]) > radius:
                break
            if int(ones[i]) - int(ones[j_end - 1]) > radius:
                continue
            near = np.bitwise_count(fp[i:i_end, None] ^ fp[None, j:j_end]) <= radius
            a, b = np.nonzero(near)
            _join(parent, a + i, b + j)
    away = np.flatnonzero(parent != np.arange(len(fp)))
    return fp[away], fp[parent[away]]


def _links(fp: np.ndarray, run: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal ``run`` numbers."""
    starts = np.flatnonzero(np.diff(run, prepend=run[0] - 1))
    sizes = np.diff(np.append(starts, len(run)))
    out_a, out_b = [], []
    is_short = np.repeat(sizes <= SHORT, sizes)
    for d in range(1, SHORT):
        a = np.flatnonzero(is_short[:-d] & (run[:-d] == run[d:])) if d < len(run) else []
        if not len(a):
            break
        a = a[np.bitwise_count(fp[a] ^ fp[a + d]) <= radius]
        out_a.append(fp[a])
        out_b.append(fp[a + d])
    for s, n in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist()):
        a, b = forest(fp[s : s + n], side[s : s + n], radius)
        out_a.append(a)
        out_b.append(b)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _deals() -> list:
    """For each two lanes: their bits and which two they are, as one long."""
    lanes, place = [], 0
    for width in LANES:
        lanes.append(F.shiftrightunsigned("fp", place).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        place += width
    pairs = combinations(range(len(LANES)), 2)
    return [
        F.lit(k << 32).cast("long").bitwiseOR(F.shiftleft(lanes[i], 11)).bitwiseOR(lanes[j])
        for k, (i, j) in enumerate(pairs)
    ]


def links(distinct: DataFrame, *, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column ``fp``) within ``radius`` bits."""
    if radius > len(LANES) - 2:
        raise ValueError(f"a radius of at most {len(LANES) - 2} is exact with these lanes")
    dealt = distinct.select("fp", F.explode(F.array(*_deals())).alias("deal"))
    sizes = dealt.groupBy("deal").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / tile_rows).cast("int")
    chunk = F.when(chunks > 1, F.pmod(F.xxhash64("fp"), chunks)).otherwise(0).cast("int")
    met = dealt.join(sizes, "deal").select("fp", "deal", chunk.alias("side"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    unit = [F.col("deal"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")]
    met = met.select("fp", *unit, "side").repartition("deal", "i", "j").sortWithinPartitions("deal", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros((0, 5), np.int64)]
        for batch in _and_last(batches):
            if batch is not None:
                rest.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            rows = np.concatenate(rest)
            if not len(rows):
                continue
            change = np.concatenate([[True], (rows[1:, 1:4] != rows[:-1, 1:4]).any(axis=1)])
            end = len(rows) if batch is None else int(np.flatnonzero(change)[-1])
            rest = [rows[end:]]
            if end:
                a, b = _links(
                    np.ascontiguousarray(rows[:end, 0]).view(np.uint64), np.cumsum(change[:end]), rows[:end, 4], radius
                )
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _and_last(batches: Iterator) -> Iterator:
    yield from batches
    yield None


# --- documents -----------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of each document."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "simhash")
    found = fingerprints(docs, id_col=id_col, text_col=text_col).withColumnRenamed(id_col, "doc_id")
    found = materialize(found, f"{path}/documents")
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), f"{path}/distinct")
    nodes = materialize(components(links(distinct, radius=radius)), f"{path}/nodes")
    nodes = nodes.withColumnRenamed("node", "fp")
    least = distinct.join(nodes, "fp").groupBy("component").agg(F.min("first_doc").alias("component_id"))
    linked = nodes.join(least, "component").select("fp", "component_id")
    classes = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_doc").alias("component_id"))
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component: the one with the least ``doc_id`` (null comes last), then the least hash of its values.

    Rows are told apart by all their values, so those without a ``doc_id`` or with a repeated one are documents of their own.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit("second"), *own).alias("h2"))
    near = near_duplicates(docs.select(row.alias("_row"), F.col(text_col)), id_col="_row", text_col=text_col, radius=radius)
    kept = near.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.h1").alias("_h1"), F.col("doc_id.h2").alias("_h2"))
    keyed = docs.withColumns({"_h1": row["h1"], "_h2": row["h2"]})
    return keyed.join(kept, ["_h1", "_h2"], "left_semi").dropDuplicates(["_h1", "_h2"]).select(*own)


def hex_digits(fp: Column) -> Column:
    """A fingerprint as sixteen lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
