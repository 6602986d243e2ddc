"""Conversation structure repair: the cheapest edits that make turns alternate.

A good conversation is empty, or an optional system turn and then pairs of a user and an assistant turn, told by the
first letter of the role. Edits of a row: Keep (0), Rerole to user or assistant (1), Delete (2); Insert puts an empty user
or assistant turn anywhere (5). Blank and repeated rows must go; a row cut off in the middle costs 5 more unless deleted.

Each row becomes a symbol of role and fault; equal symbols in a row are one run. The cost to the end from each of four
states is carried backward over the runs: a run of any length takes a few products with the binary powers of its
symbol's min-plus transition, which are worked out once. Then the runs are unrolled forward, halving each by the same
powers, and at every row the ASCII-least letter on a cheapest way is taken; blocks that come again are remembered.

Two streams over rows sorted by conversation: a narrow one (symbols; memory for the runs and the audit) and a wide
one (texts, row by row, after the audit). A conversation is one task's, as its audit is one string; its texts are never held together.

Defined cases: a null role or text is one space; rows are ordered by turn (null first), then role and text; a null ``conv_id`` is a
conversation of its own; equal rows repeat each other; texts and conversations may be of any length; an empty table gives no
row; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Costs of the edits, and white space.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
SPACE = " \t\n\x0b\x0c\r"
# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
_STATES = range(4)
_FRESH, _SYSTEM, _USER, _ASSISTANT = _STATES
#: The state after a user or assistant turn that is put where it belongs.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_KEEP = {"s": {_FRESH: _SYSTEM}, "u": {_FRESH: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
_LEGAL = {"su", "ua", "au"}
_NO_WAY = 1 << 60
GONE = "x"  # the symbol of rows that must go

Costs = tuple[int, ...]
Matrix = tuple[Costs, ...]


# --- the transition of a symbol, its powers, and what they do to costs -----------------------


def _choices(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits that take one row, the ASCII-least first.

    A symbol is the initial of the role, in upper case for a truncated row, or ``GONE``.
    """
    out = [("D", DELETE, state)]
    if symbol != GONE:
        more = TRUNCATED if symbol.isupper() else 0
        kept = _KEEP.get(symbol.lower(), {}).get(state)
        if kept is not None:
            out.append(("K", more, kept))
        out.append(("R", REROLE + more, _NEXT[state]))
    return out


def _inserted() -> Matrix:
    """Least cost to get from state to state by inserting alone."""
    out = []
    for start in _STATES:
        costs, state = [_NO_WAY] * 4, start
        for n in range(4):
            costs[state] = min(costs[state], n * INSERT)
            state = _NEXT[state]
        out.append(tuple(costs))
    return tuple(out)


def _product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[p][r] + b[r][q] for r in _STATES) for q in _STATES) for p in _STATES)


def _before(a: Matrix, after: Costs) -> Costs:
    return tuple(min(a[p][q] + after[q] for q in _STATES) for p in _STATES)


_INSERTED = _inserted()
#: Cost to the end when no row is left.
_AT_END = _before(_INSERTED, (0, _NO_WAY, _NO_WAY, 0))


@lru_cache(maxsize=4096)
def power(symbol: str, k: int) -> Matrix:
    """The min-plus transition of ``2 ** k`` rows with this symbol, inserts ahead of each included."""
    if k:
        half = power(symbol, k - 1)
        return _product(half, half)
    row = [[_NO_WAY] * 4 for _ in _STATES]
    for p in _STATES:
        for _, cost, q in _choices(symbol, p):
            row[p][q] = min(row[p][q], cost)
    return _product(_INSERTED, tuple(map(tuple, row)))


def _carried(symbol: str, n: int, after: Costs) -> Costs:
    """Costs ahead of a run of ``n`` rows from those behind it."""
    k = 0
    while n:
        if n & 1:
            after = _before(power(symbol, k), after)
        n, k = n >> 1, k + 1
    return after


@lru_cache(maxsize=1 << 13)
def _block(symbol: str, k: int, state: int, after: Costs) -> tuple[str, int]:
    """Letters for ``2 ** k`` rows of a symbol, and the state behind them; ``after`` counts from its least."""
    if k:
        left, state = _block(symbol, k - 1, state, _from_least(_before(power(symbol, k - 1), after)))
        right, state = _block(symbol, k - 1, state, after)
        return left + right, state
    here, letters = _before(power(symbol, 0), after), ""
    while True:
        taken = [(letter, q) for letter, cost, q in _choices(symbol, state) if cost + after[q] == here[state]]
        if taken and taken[0][0] < "I":
            return letters + taken[0][0], taken[0][1]
        if INSERT + here[_NEXT[state]] == here[state]:
            letters, state = letters + "I", _NEXT[state]
            continue
        return letters + taken[0][0], taken[0][1]


def _from_least(costs: Costs) -> Costs:
    least = min(costs)
    return tuple(min(c - least, _NO_WAY) for c in costs)


#: Blocks of up to so many rows (a power of two) are remembered whole.
_REMEMBERED = 10


def _unrolled(symbol: str, n: int, state: int, after: Costs) -> tuple[str, int]:
    """Letters for a run of ``n`` rows: its binary blocks, the small ones last."""
    parts = [k for k in range(n.bit_length()) if n >> k & 1 and k < _REMEMBERED]
    parts += [_REMEMBERED] * (n >> _REMEMBERED)
    behind = [after]
    for k in parts[:-1]:
        behind.append(_from_least(_before(power(symbol, k), behind[-1])))
    letters = []
    for k, costs in zip(reversed(parts), reversed(behind)):
        some, state = _block(symbol, k, state, _from_least(costs))
        letters.append(some)
    return "".join(letters), state


def cheapest(runs: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and audit of a conversation given as (symbol, number of rows) runs."""
    costs, behind = _AT_END, []
    for symbol, n in reversed(runs):
        behind.append(costs)
        costs = _carried(symbol, n, costs)
    state, letters = _FRESH, []
    for (symbol, n), after in zip(runs, reversed(behind)):
        some, state = _unrolled(symbol, n, state, _from_least(after))
        letters.append(some)
    while state not in (_FRESH, _ASSISTANT):
        state = _NEXT[state]
        letters.append("I")
    return costs[_FRESH], "".join(letters)


# --- rows with their faults ------------------------------------------------------------------


def with_faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, nr, role, text, fault): rows numbered within their conversation, and the first fault of each."""
    df = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    df = df.withColumn("nr", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).cast("long"))
    same = Window.partitionBy("conv_id", "role", "text").orderBy("nr")
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", "blank").when(F.col("_again"), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    return df.withColumn("_again", F.row_number().over(same) > 1).select("conv_id", "turn", "nr", "role", "text", fault.alias("fault"))


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


# --- the narrow stream: one plan for each conversation ---------------------------------------

_PLAN = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string"}
_NOTHING = object()


class _Plan:
    def __init__(self, conv):
        self.conv, self._runs, self._last = conv, [], ""
        self._least = self._most = None
        self._turns = self._illegal = 0
        self._faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn: int | None, initial: str, fault: str | None) -> None:
        if fault is not None:
            self._faults[fault] += 1
        symbol = GONE if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        if self._runs and self._runs[-1][0] == symbol:
            self._runs[-1][1] += 1
        else:
            self._runs.append([symbol, 1])
        self._illegal += self._last != "" and self._last + initial not in _LEGAL
        self._last = initial
        if turn is not None:
            self._least = turn if self._least is None else self._least
            self._turns += turn != self._most
            self._most = turn

    def row(self) -> tuple:
        gaps = self._most - self._least + 1 - self._turns if self._turns else 0
        return self.conv, gaps, *self._faults.values(), self._illegal, *cheapest([tuple(r) for r in self._runs])


def plans(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) from the rows of ``with_faults``.

    ``conversations(conv_id)``, without repeats, names those that are returned even without a row.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    narrow = rows.select("conv_id", "nr", F.col("turn").cast("long").alias("turn"), _initial(F.col("role")).alias("initial"), "fault")
    if conversations is not None:
        narrow = narrow.unionByName(conversations.select("conv_id", F.lit(0).cast("long").alias("nr")), allowMissingColumns=True)
    names = ["conv_id", *_PLAN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None
        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, nr, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    done += [now.row()] if now else []
                    now = _Plan(conv)
                if nr:
                    now.add(turn, initial, fault)
            if len(done) >= 4096:
                yield _batch(done, conv_type, names)
                done = []
        done += [now.row()] if now else []
        if done:
            yield _batch(done, conv_type, names)

    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "nr")
    return ordered.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{n} {t}" for n, t in _PLAN.items()))


def _batch(done: list[tuple], conv_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [conv_type, *[pa.int64()] * 6, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)


# --- the wide stream: the edits are made -----------------------------------------------------


class _Editor:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, conv, audit: str):
        self.conv, self._audit, self._at, self._state = conv, audit, 0, _FRESH

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self._audit[self._at : self._at + 1] == "I":
            yield self._fitting(), ""
            self._at, self._state = self._at + 1, _NEXT[self._state]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self._audit[self._at]
        self._at += 1
        if letter == "R":
            role = self._fitting()
        if letter != "D":
            self._state = _KEEP[role[0]][self._state]
            yield role, text

    def _fitting(self) -> str:
        return "assistant" if self._state == _USER else "user"


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns after the edits, ``place`` from 0.

    Each conversation's turns are in order, one after another, within a partition.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    both = rows.select("conv_id", "nr", "role", "text").unionByName(
        plans.select("conv_id", F.lit(0).cast("long").alias("nr"), "audit"), allowMissingColumns=True
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place = None, 0
        for batch in batches:
            out = []
            for conv, nr, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
                if nr == 0:
                    out += _placed(now, now.inserted(), place) if now else []
                    now, place = _Editor(conv, audit), 0
                else:
                    some = _placed(now, now.row(role, text), place)
                    out += some
                    place += len(some)
            if out:
                yield _turns(out, batch.schema.field(0).type)
        out = _placed(now, now.inserted(), place) if now else []
        if out:
            yield _turns(out, batch.schema.field(0).type)

    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "nr")
    return ordered.select("conv_id", "nr", "role", "text", "audit").mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def _placed(editor: _Editor, made: Iterator[tuple[str, str]], place: int) -> list[tuple]:
    return [(editor.conv, place + i, role, text) for i, (role, text) in enumerate(made)]


def _turns(out: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    kinds = [conv_type, pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "place", "role", "text"])


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the turns of ``repaired`` as lines ``role:text``; they are hashed as they come."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = _NOTHING, None
        for batch in batches:
            done, conv_type = [], batch.schema.field(0).type
            for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is _NOTHING or place == 0:
                    done += [(now, digest.hexdigest())] if digest else []
                    now, digest = conv, hashlib.sha256()
                digest.update((f"{role}:{text}" if place == 0 else f"\n{role}:{text}").encode())
            if done:
                yield _hashes(done, conv_type)
        if digest:
            yield _hashes([(now, digest.hexdigest())], conv_type)

    return turns.select("conv_id", "place", "role", "text").mapInArrow(run, f"conv_id {kind}, sha256 string")


def _hashes(done: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    convs, hashes = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(convs, conv_type), pa.array(hashes, pa.string())], ["conv_id", "sha256"])
