"""Chat formatting: typed content parts, a template with escapes, loss masks.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them in
order: text is escaped, and any other part becomes a placeholder; its reference and the number of
tokens that it expands to are recorded. The template is

    <|im_start|>role NEWLINE content<|im_end|>NEWLINE

Control strings inside texts and roles are escaped by a backslash more between ``<`` and ``|``
(``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|``), which ``unescape`` takes back; a line break in a role
becomes ``<\\n|`` likewise. So no text can end or begin a turn.

The result has one row for each turn: its segment of the conversation, where the segment
begins, and the span of the conversation that the loss counts. A conversation may be of any length: its
segments are never joined in one row, and where they begin is a running sum.

Defined cases: a null text is empty, a null role too; turns are ordered by ``turn`` (null
first), equal ones by role and text; repeated rows are turns of their own; a part of an unknown type
or null is an empty text; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings.
START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

#: A content part. ``width`` and ``height`` are pixels, ``seconds`` the length of audio, ``pages`` of a document.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH = 28  # pixels of a side of the square that is one token of an image
AUDIO_RATE = 25  # tokens a second
PAGE_TOKENS = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: Column) -> Column:
    marked = F.regexp_replace(F.coalesce(role, F.lit("")), r"<(\\*)([n|])", r"<\\$1$2")
    return F.replace(marked, F.lit("\n"), F.lit("<n|"))


def unescape_role(role: str) -> str:
    return re.sub(r"<\\(\\*)([n|])", r"<\1\2", role.replace("<n|", "\n"))


# --- the visitor: for each type of part its placeholder and its tokens -----------------------


def _image(part: Column) -> Column:
    side = lambda x: F.ceil(F.greatest(F.coalesce(x, F.lit(PATCH)), F.lit(1)) / PATCH)
    return side(part["width"]) * side(part["height"])


def _audio(part: Column) -> Column:
    return F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE), F.lit(1))


def _document(part: Column) -> Column:
    return F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS


VISITOR: dict[str, Callable[[Column], Column]] = {"image": _image, "audio": _audio, "document": _document}


def flatten(parts: Column) -> Column:
    """The content of parts: escaped texts and placeholders, in order.

    Texts that follow one another are escaped as one, so a control string can't be put together from several.
    """

    def visit(acc: Column, part: Column) -> Column:
        placeholder = F.lit(None).cast("string")
        for kind, shown in PLACEHOLDERS.items():
            placeholder = F.when(part["type"] == kind, F.lit(shown)).otherwise(placeholder)
        text = F.when(part["type"] == "text", F.coalesce(part["text"], F.lit(""))).otherwise("")
        done = F.when(placeholder.isNull(), acc["done"]).otherwise(F.concat(acc["done"], escape(acc["run"]), placeholder))
        run = F.when(placeholder.isNull(), F.concat(acc["run"], text)).otherwise("")
        return F.struct(done.alias("done"), run.alias("run"))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("run"))
    return F.aggregate(parts, start, visit, lambda acc: F.concat(acc["done"], escape(acc["run"])))


def attachments(parts: Column) -> Column:
    """(type, ref, tokens) of the parts that are no text, in order of their placeholders."""

    def recorded(part: Column) -> Column:
        tokens = F.lit(0).cast("bigint")
        for kind, count in VISITOR.items():
            tokens = F.when(part["type"] == kind, count(part).cast("bigint")).otherwise(tokens)
        return F.struct(part["type"].alias("type"), part["ref"].alias("ref"), tokens.alias("tokens"))

    return F.transform(F.filter(parts, lambda p: F.coalesce(p["type"].isin(*PLACEHOLDERS), F.lit(False))), recorded)


def text_part(text: Column) -> Column:
    """A content of one text part."""
    names = ["type", "text", "ref", "width", "height", "seconds", "pages"]
    values = [F.lit("text"), text, *[F.lit(None)] * 5]
    return F.array(F.struct(*[v.alias(n) for n, v in zip(names, values)]).cast(PART))


def format_turns(turns: DataFrame, *, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, segment, begin, loss_begin, loss_end, attachments) from (conv_id, turn, role, parts).

    Places count code points from the beginning of the conversation; the loss covers the whole
    content of turns with one of ``loss_roles``, else its span is null.
    """
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    df = turns.select("conv_id", "turn", "role", parts.alias("parts"))
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    df = df.select("conv_id", "turn", "role", head.alias("head"), flatten(F.col("parts")).alias("content"), attachments(F.col("parts")).alias("attachments"))
    df = df.withColumn("segment", F.concat("head", "content", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    size = F.length("segment").cast("bigint")
    df = df.withColumn("nr", F.row_number().over(order))
    df = df.withColumn("begin", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size)
    loss_begin = F.when(F.col("role").isin(*loss_roles), F.col("begin") + F.length("head"))
    return df.select(
        "conv_id", "turn", "nr", "segment", "begin", loss_begin.alias("loss_begin"),
        (loss_begin + F.length("content")).alias("loss_end"), "attachments",
    )


# --- reading back ----------------------------------------------------------------------------


def parse(segment: str) -> tuple[str, str]:
    """Role and escaped content of a formatted turn."""
    if not segment.startswith(START) or not segment.endswith(END + "\n"):
        raise ValueError("not a formatted turn")
    role, _, content = segment[len(START) : -len(END) - 1].partition("\n")
    return unescape_role(role), content


def read_back(formatted: DataFrame) -> DataFrame:
    """A digest of each formatted conversation: its turns, the text under its loss mask, its length.

    Segments arrive in order and are hashed as they come, so a long conversation is never held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now = None
        for batch in batches:
            for conv, segment, begin, loss_begin, loss_end in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    done += [now.row()] if now else []
                    now = _Digest(conv)
                now.add(segment, begin, loss_begin, loss_end)
            if len(done) > 4096:
                yield _rows(done)
                done = []
        done += [now.row()] if now else []
        if done:
            yield _rows(done)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "nr")
    return ordered.select("conv_id", "segment", "begin", "loss_begin", "loss_end").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


class _Digest:
    def __init__(self, conv):
        self.conv, self._turns, self._loss = conv, hashlib.sha256(), hashlib.sha256()
        self._n = self._chars = self._loss_chars = 0

    def add(self, segment: str, begin: int, loss_begin: int | None, loss_end: int | None) -> None:
        if begin != self._chars:
            raise ValueError("segments of a conversation are missing or out of order")
        role, content = parse(segment)
        self._turns.update(f"{role}\n{unescape(content)}\n".encode())
        if loss_begin is not None:
            text = unescape(segment[loss_begin - begin : loss_end - begin])
            self._loss.update(text.encode())
            self._loss_chars += len(text)
        self._n += 1
        self._chars += len(segment)

    def row(self) -> tuple:
        return self.conv, self._n, self._turns.hexdigest(), self._loss_chars, self._loss.hexdigest(), self._chars


def _rows(done: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
