"""WARC records in ZIP packages, and a reader that takes ranges out of them.

A package is a ZIP file whose members are stored without compression:
``archive/data.warc.gz`` (each record a gzip member of its own), ``indexes/index.cdxj`` (one line
of JSON for each record: where it lies in the archive) and ``datapackage.json``. The reader
parses the central directory (the ZIP64 one too), finds where a stored member lies, reads its
index and then ranges of records. Nothing is extracted, and packages made elsewhere work as well;
an archive without an index is walked from record to record.

Pages with equal payloads of at least ``LEAST_BYTES`` bytes are stored once: the one with the least
``page_id`` is a response, the others are revisits that name it. A revisit keeps the HTTP head, so it
tells the length and digest of the payload.

Packages get fresh names and are listed in a table when their task has finished, so
repeated and lost tasks leave nothing that a reader sees. The join that finds the first page
of a payload is salted, and has only payloads that occur twice on its other side.

Defined cases: a null html is an empty payload; a null url is left out; control characters of a url
are percent-encoded; a null ``page_id`` is kept and its record is always a response; rows with the least
``page_id`` of a payload are all responses; an empty table gives no package; other columns are not read.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.skew import salted_join
from pagesieve.functions.storage import materialize
from pagesieve.llm.files import open_for_reading, open_for_writing, read_tasks

LEAST_BYTES = 100
PACKAGE_RECORDS = 100_000
PACKAGE_BYTES = 1 << 30
SPAN_BYTES = 2 << 20
DATE = "2000-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TASK_BYTES = 64 << 20


# --- ZIP directories ---------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    flags: int
    size: int
    packed: int
    header: int


def _at(source, place: int, size: int) -> bytes:
    source.seek(place)
    return source.read(size)


def directory(source) -> list[Member]:
    """The members that the central directory of a ZIP file lists."""
    size = source.size()
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = _at(source, tail_at, size - tail_at)
    found = len(tail)
    while (found := tail.rfind(b"PK\x05\x06", 0, found)) >= 0:
        if len(tail) - found >= 22 and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] == len(tail):
            break
    else:
        raise ValueError("no end of a central directory")
    n, length, place = struct.unpack_from("<HII", tail, found + 10)
    end = tail_at + found
    locator = _at(source, max(0, end - 20), 20)
    if locator.startswith(b"PK\x06\x07"):
        (at,) = struct.unpack_from("<Q", locator, 8)
        mark, n, length, place = struct.unpack("<4s28xQQQ", _at(source, at, 56))
        if mark != b"PK\x06\x06":
            raise ValueError("the ZIP64 directory is damaged")
        shift = 0
    else:
        shift = end - length - place  # bytes put before the archive
    return list(_entries(_at(source, place + shift, length), n, shift))


def _entries(data: bytes, n: int, shift: int) -> Iterator[Member]:
    at = 0
    for _ in range(n):
        mark, flags, method, packed, size, names, extra, remark, header = struct.unpack_from("<4s4xHH8xIIHHH8xI", data, at)
        if mark != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        at += 46
        name = data[at : at + names].decode("utf-8" if flags & 0x800 else "cp437")
        size, packed, header = _wide(data[at + names : at + names + extra], size, packed, header)
        yield Member(name, method, flags, size, packed, header + shift)
        at += names + extra + remark


def _wide(extra: bytes, *values: int) -> tuple[int, ...]:
    """Values that did not fit into 32 bits, from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return tuple(next(wide) if v == 0xFFFFFFFF else v for v in values)
        at += 4 + size
    return values


def stored_at(source, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0 or member.flags & 1:
        raise ValueError(f"{member.name} is not stored as it is")
    mark, names, extra = struct.unpack("<4s22xHH", _at(source, member.header, 30))
    if mark != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no header")
    return member.header + 30 + names + extra


# --- records -----------------------------------------------------------------------------


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC record; a revisit if it refers to a page."""
    name = "none" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def parse_record(data: bytes) -> dict:
    """Names, digest, length and payload (null for revisits) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, page = fields["warc-type"], fields["warc-record-id"]
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2]
    return {
        "page_id": _page(page), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")),
        "told_digest": digest, "told_bytes": int(_fields(http).get("content-length", len(payload))), "payload": payload if kind == "response" else None,
    }


def _page(name: str | None) -> int | None:
    found = re.search(r"urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _walk(source, place: int, size: int) -> Iterator[tuple[int, int]]:
    """Place and length of each gzip member of an archive without an index."""
    at, end = place, place + size
    while at < end:
        tool, read = zlib.decompressobj(31), at
        while not tool.eof:
            piece = _at(source, read, min(1 << 16, end - read))
            if not piece:
                raise ValueError("the last record is cut off")
            tool.decompress(piece)
            read += len(piece)
        read -= len(tool.unused_data)
        yield at - place, read - at
        at = read


def index_of(source) -> tuple[int, list[tuple[int, int]]]:
    """Where the archive of a package begins, and place and length of each of its records."""
    members = {m.name: m for m in directory(source)}
    archive = next(m for n, m in sorted(members.items()) if n.endswith(".warc.gz"))
    begin = stored_at(source, archive)
    index = next((m for n, m in sorted(members.items()) if n.startswith("indexes/")), None)
    if index is None:
        return begin, list(_walk(source, begin, archive.size))
    lines = _at(source, stored_at(source, index), index.size).decode().splitlines()
    entries = [json.loads(line[line.index("{") :]) for line in lines]
    return begin, sorted((e["offset"], e["length"]) for e in entries)


# --- on Spark ----------------------------------------------------------------------------


class _Package:
    def __init__(self, path: str):
        self.path, self.records, self.bytes = path, 0, 0
        self._out = open_for_writing(path)
        self._zip = zipfile.ZipFile(self._out, "w", zipfile.ZIP_STORED)
        self._archive = self._zip.open(ARCHIVE, "w", force_zip64=True)
        self._index: list[str] = []

    def add(self, data: bytes, page_id) -> None:
        packed = gzip.compress(data, 6, mtime=0)
        self._archive.write(packed)
        self._index.append(f"{page_id} " + json.dumps({"offset": self.bytes, "length": len(packed)}))
        self.records, self.bytes = self.records + 1, self.bytes + len(packed)

    def close(self) -> dict:
        self._archive.close()
        self._zip.writestr(INDEX, "\n".join(self._index))
        self._zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE}, {"path": INDEX}]}))
        self._zip.close()
        self._out.close()
        return {"path": self.path, "records": self.records, "bytes": self.bytes}


def with_first(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of pages."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    df = df.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= LEAST_BYTES
    twice = df.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    joined = salted_join(df, twice.select("digest", "first"), "digest", ["page_id", "url"], "left")
    refers = F.when(large & (F.col("page_id") != F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each page; the table of packages (path, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[k].as_py() for c in batch.columns)
                package = package or _Package(f"{folder}/packages/pages-{uuid.uuid4().hex}.wacz")
                package.add(record(page_id, url, payload.encode(), digest, refers_to), page_id)
                if package.records >= PACKAGE_RECORDS or package.bytes >= PACKAGE_BYTES:
                    done, package = [*done, package.close()], None
        done += [package.close()] if package else []
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return materialize(with_first(pages).mapInArrow(run, "path string, records long, bytes long"), f"{folder}/listing")


def read_packages(packages: DataFrame) -> DataFrame:
    """A row for each record: page_id, url, record_type, refers_to, told_digest, told_bytes, payload.

    The indexes are read first; then each task reads ranges of about ``SPAN_BYTES`` bytes.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_for_reading(path) as source:
                    begin, entries = index_of(source)
                out, own, held = [], [], 0
                for i, (place, length) in enumerate(entries):
                    own.append(length)
                    held += length
                    follows = i + 1 < len(entries) and entries[i + 1][0] == place + length
                    if held >= SPAN_BYTES or not follows:
                        out.append({"path": path, "place": begin + place + length - held, "lengths": own})
                        own, held = [], 0
                yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("place", pa.int64()), ("lengths", pa.list_(pa.int64()))]))

    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("told_digest", pa.string()), ("told_bytes", pa.int64()), ("payload", pa.binary()),
    ])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, place, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                with open_for_reading(path) as source:
                    data = _at(source, place, sum(lengths))
                rows, at = [], 0
                for n in lengths:
                    rows.append(parse_record(gzip.decompress(data[at : at + n])))
                    at += n
                yield pa.RecordBatch.from_pylist(rows, schema)

    tasks = read_tasks(packages.sparkSession, packages.agg(F.sum("bytes")).first()[0], TASK_BYTES)
    ranges = packages.select("path").repartition(tasks, "path").mapInArrow(spans, "path string, place long, lengths array<long>")
    spread = ranges.repartition(tasks, "path", "place")
    return spread.mapInArrow(
        records, "page_id long, url string, record_type string, refers_to long, told_digest string, told_bytes long, payload binary"
    )
