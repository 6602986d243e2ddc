"""Find every match of a set of expressions, with positions, in one plan.

Spark has no find-all that reports positions.  Here each expression rewrites the
text once, fencing its matches with a separator that the text lacks; splitting on the separator gives
``gap, match, value, following, idle, gap, ...`` and a running sum over the piece
lengths gives offset, line and column.  The pieces leave the document's row in blocks of
``SPAN`` matches, each with the offset, line and column at which it begins, and become matches
block by block, so a text with very many matches never has them all in one row.  A text is only
rewritten for expressions that pass their substring test; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.regex import Rx, candidates, dispatch, quoted, with_signs

# Unicode noncharacters: never valid in interchanged text.  A text is fenced with the first that it lacks.
FENCES = [chr(c) for c in range(0xFDD0, 0xFDF0)]
STRIDE = 5  # pieces per match: gap, match, value, following text, idle stretch
BLOCK = 64  # running sums grow an array per block, keeping them linear overall
SPAN = 1024  # matches that leave a document's row together

_POSITION = "struct<off:int,line:int,col:int,ahead:string,idx:int>"
_START = "struct<off:int,line:int,tail:int,ahead:string>"
_STATE = f"struct<off:int,line:int,tail:int,ahead:string,out:array<{_POSITION}>>"
_NL = "'\\n'"


def fence_of(text: str) -> str:
    """SQL for a separator that ``text`` lacks; null if it has them all."""
    return "CASE " + " ".join(f"WHEN NOT contains({text}, '{f}') THEN '{f}'" for f in FENCES) + " END"


def with_fence(df: DataFrame, text: str) -> DataFrame:
    """Add ``_fence``.  Only a text with all 32 separators is changed: its U+FDD0 becomes U+FFFD."""
    df = df.withColumn("_fence", F.expr(fence_of(text)))
    freed = F.translate(text, FENCES[0], "\ufffd")
    return df.withColumns({
        text: F.when(F.col("_fence").isNull(), freed).otherwise(F.col(text)), "_fence": F.coalesce("_fence", F.lit(FENCES[0])),
    })


def fenced(text: str, rx: Rx, after: int = 0) -> str:
    """SQL for ``text`` with each match fenced as match, value, following text, idle stretch."""
    follow = f"(?=((?s:.{{0,{after}}})))" if after else "()"
    # one more group at the end holds up to ``after`` characters behind the match
    pattern = f"(?dU{rx.flags})(?:(?:{rx.java or rx.pattern})|({rx.idle or '(?!)'})){follow}"
    parts = [f"'${g}', _fence" for g in (0, rx.value_group, rx.groups + 2, rx.groups + 1)]
    return f"regexp_replace({text}, {quoted(pattern)}, concat(_fence, {', '.join(parts)}))"


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _tail(text: str, width: int) -> str:
    return f"substring({text}, -{width}, {width})" if width else "''"


def _count(pieces: str) -> str:
    """Matches among ``pieces``, which may end with a gap."""
    return f"CAST(size({pieces}) div {STRIDE} AS INT)"


def _measured(pieces: str) -> str:
    """Length, newlines and length behind the last newline of each gap and match, none for no match."""

    def sizes(name: str, piece: str) -> str:
        return (
            f"'{name}l', length({piece}), '{name}n', length({piece}) - length(replace({piece}, {_NL}, '')), "
            f"'{name}t', length(substring_index({piece}, {_NL}, -1))"
        )

    gap, hit = f"{pieces}[i * {STRIDE}]", f"{pieces}[i * {STRIDE} + 1]"
    return f"transform(sequence(0, {_count(pieces)} - 1), i -> named_struct({sizes('g', gap)}, {sizes('h', hit)}))"


_COL = "if(z[i].gn > 0, z[i].gt, s.tail + z[i].gl)"


def _moved(pieces: str, before: int) -> str:
    """Fields of the state ``s`` behind match ``i`` of ``pieces``, whose sizes are ``z``."""
    gap, hit = f"{pieces}[i * {STRIDE}]", f"{pieces}[i * {STRIDE} + 1]"
    return (
        f"'off', s.off + z[i].gl + z[i].hl, 'line', s.line + z[i].gn + z[i].hn, "
        f"'tail', if(z[i].hn > 0, z[i].ht, {_COL} + z[i].hl), "
        f"'ahead', {_tail(f'concat(s.ahead, {_tail(gap, before)}, {hit})', before)}"
    )


def _behind(pieces: str, start: str, before: int) -> str:
    """SQL for the state behind all ``pieces``."""
    fold = f"aggregate(sequence(0, size(z) - 1), {start}, (s, i) -> CAST(named_struct({_moved(pieces, before)}) AS {_START}))"
    return _let("z", _measured(pieces), fold)


def _blocks(before: int, lines: dict[str, str], margin: tuple[int, int]) -> str:
    """SQL over the array ``p`` of pieces of expression ``k``: its blocks.

    A block has the state ahead of its first match, that match's number, its pieces, and of each array in ``lines``
    (one entry a line) the part that its matches can refer to, which begins with line ``since``.
    """
    zero = f"CAST(named_struct('off', 0, 'line', 1, 'tail', 0, 'ahead', '') AS {_START})"
    step = f"concat(acc, array({_behind('q', 'element_at(acc, -1)', before)}))"
    states = (
        f"if(n <= {SPAN}, array({zero}), aggregate(sequence(1, CAST((n - 1) div {SPAN} AS INT)), array({zero}), (acc, j) -> "
        f"{_let('q', f'slice(p, (j - 1) * {SPAN * STRIDE} + 1, {SPAN * STRIDE})', step)}))"
    )
    since = f"greatest(s.line - {margin[0]}, 1)"
    parts = "".join(
        f", '{name}', if(size(b) = 1, {name}, if(j + 1 = size(b), slice({name}, {since}, size({name})), "
        f"slice({name}, {since}, b[j + 1].line + {margin[1]} - {since} + 1)))" for name in lines
    )
    whole = f"if(size(b) = 1, p, slice(p, j * {SPAN * STRIDE} + 1, {SPAN * STRIDE}))"
    block = f"named_struct('k', k, 'nth', j * {SPAN}, 'at', s, 'since', {since}, 'p', {whole}{parts})"
    out = _let("b", states, f"transform(b, (s, j) -> {block})")
    return _let("n", f"CAST((size(p) - 1) div {STRIDE} AS INT)", f"if(n > 0, {out}, slice({out}, 1, 0))")


def _positions(before: int) -> str:
    """SQL over the pieces ``p`` of the block ``_b``: offset, line, column and the text ahead of each gap.

    Piece sizes come first; a running sum over them, kept per block, gives the rest.
    """
    here = f"named_struct('off', s.off + z[i].gl, 'line', s.line + z[i].gn, 'col', {_COL} + 1, 'ahead', s.ahead, 'idx', i)"
    step = f"named_struct({_moved('p', before)}, 'out', concat(s.out, array({here})))"

    def state(last: str) -> str:
        fields = ", ".join(f"'{f}', {last}.{f}" for f in ("off", "line", "tail", "ahead"))
        return f"CAST(named_struct({fields}, 'out', CAST(array() AS array<{_POSITION}>)) AS {_STATE})"

    inside = f"sequence(b, least(b + {BLOCK - 1}, size(z) - 1))"
    block = f"concat(acc, array(aggregate({inside}, {state('element_at(acc, -1)')}, (s, i) -> {step})))"
    blocks = f"aggregate(sequence(0, size(z) - 1, {BLOCK}), array({state('_b.at')}), (acc, b) -> {block})"
    return _let("z", _measured("p"), f"flatten(transform({blocks}, s -> s.out))")


def _row(before: int, derive: dict[str, str] | None) -> str:
    """SQL for the match ``m`` of the block ``_b`` with pieces ``p``."""
    fields = {
        "rx": "_b.k", "nth": "_b.nth + m.idx", "off": "m.off", "line": "m.line", "col": "m.col",
        "hit": f"p[m.idx * {STRIDE} + 1]", "value": f"p[m.idx * {STRIDE} + 2]",
        "before": _tail(f"concat(m.ahead, p[m.idx * {STRIDE}])", before),
        "after": f"p[m.idx * {STRIDE} + 3]", **(derive or {}),
    }
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields.items()) + ")"


def located(rxs: list[Rx], before: int, derive: dict[str, str] | None) -> str:
    """SQL for the array of matches of the block ``_b``."""
    places = _positions(before)
    if any(r.idle for r in rxs):
        places = f"filter({places}, m -> p[m.idx * {STRIDE} + 4] = '')"
    return _let("p", "_b.p", f"transform({places}, m -> {_row(before, derive)})")


def in_blocks(
    rxs: list[Rx], text: str, pick: str, before: int, after: int, lines: dict[str, str] | None, margin: tuple[int, int]
) -> str:
    """SQL for the blocks of all picked expressions in a text with ``_fence``."""
    pieces = f"split({dispatch('k', [fenced(text, r, after) for r in rxs])}, _fence, -1)"
    return f"flatten(transform({pick}, k -> {_let('p', pieces, _blocks(before, lines or {}, margin))}))"


def scan(
    df: DataFrame,
    text: str,
    rxs: list[Rx],
    *,
    before: int = 0,
    after: int = 0,
    pick: Column | None = None,
    lines: dict[str, str] | None = None,
    margin: tuple[int, int] = (0, 0),
    derive: dict[str, str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per match of any of ``rxs`` in column ``text``.

    Output: the ``keep`` columns, then ``rx`` (ordinal of the expression), ``nth``
    (match number within it), ``off`` (0-based), ``line`` and ``col`` (1-based),
    ``hit``, ``value`` (group 1 or the whole match), ``before`` and ``after``
    (surrounding text up to the given widths) and the ``derive`` columns: SQL over
    the match ``m`` and the arrays of ``lines``: SQL with one entry for each line of the text,
    worked out once per text that may match at all, of which a match sees the entries
    from ``margin`` lines ahead of it to as many behind, its own at ``m.line - _b.since``.  ``pick`` replaces the substring tests
    by an own array of ordinals.  Rows keep the input partitioning; there
    is no shuffle.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != text]
    if pick is None:
        df = with_signs(df, text, rxs).withColumn("_pick", F.expr(candidates(rxs, text)))
    else:
        df = df.withColumn("_pick", pick)
    df = with_fence(df, text)
    for name, sql in (lines or {}).items():
        df = df.withColumn(name, F.expr(f"if(size(_pick) > 0, {sql}, NULL)"))
    blocks = df.select(*keep, F.expr(f"explode_outer({in_blocks(rxs, text, '_pick', before, after, lines, margin)})").alias("_b"))
    return matches(blocks.filter("_b IS NOT NULL"), keep, located(rxs, before, _seen(derive, lines)))


def matches(blocks: DataFrame, keep: list[str], located: str) -> DataFrame:
    found = blocks.select(*keep, F.expr(f"explode_outer({located})").alias("_m"))
    return found.filter("_m IS NOT NULL").select(*keep, "_m.*")


def _seen(derive: dict[str, str] | None, lines: dict[str, str] | None) -> dict[str, str]:
    """``derive`` over the arrays that came with the block."""
    out = {}
    for name, sql in (derive or {}).items():
        for array in lines or {}:
            sql = sql.replace(array, f"_b.{array}")
        out[name] = sql
    return out


def _values(rx: Rx) -> str:
    if rx.closer:
        return _between_closers(rx)
    found = f"regexp_extract_all(_t, {quoted(rx.jvm())}, {rx.value_group})"
    # an idle stretch has no value, and expressions that have one never match without
    return f"filter({found}, v -> v <> '')" if rx.idle else found


def _between_closers(rx: Rx) -> str:
    """SQL for the values of an expression with a closer.

    The closers are found once. A part of the text that one ends which something fitting follows is searched with that end put back; its
    first opener takes all of it. In any other part only matches without a closer can lie.
    """
    sign, follows, without = rx.closer
    ends = f"get(z, j + 1) RLIKE {quoted(f'^(?:(?dU{rx.flags}){follows})')}"
    # no more of the next part than follows the closer: the rest is searched in its own turn
    end = f"regexp_extract(get(z, j + 1), {quoted(f'^(?:(?dU{rx.flags}){follows})')}, 0)"
    closed = f"regexp_extract_all(concat(x, '{sign}', {end}), {quoted(rx.jvm())}, {rx.value_group})"
    alone = f"regexp_extract_all(x, {quoted(f'(?dU{rx.flags}){without}')}, 1)"
    part = f"transform(z, (x, j) -> if({ends}, {closed}, {alone}))"
    return f"flatten({_let('z', f'split(_t, {quoted(chr(92) + sign)}, -1)', part)})"


def extract_values(
    df: DataFrame, text: str, rxs: list[Rx], *, keep: list[str] | None = None
) -> DataFrame:
    """One row per match, without positions: ``rx``, ``nth`` and ``value``.

    Made for short texts such as lines: expressions that pass the substring test
    become rows, then each row runs just its own expression.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != text]
    df = with_signs(df, text, rxs).withColumn("_pick", F.expr(candidates(rxs, text)))
    routed = df.select(*keep, F.col(text).alias("_t"), F.explode_outer("_pick").alias("rx"))
    hits = dispatch("rx", [_values(r) for r in rxs])
    found = routed.filter("rx IS NOT NULL").select(*keep, "rx", F.expr(f"posexplode_outer({hits})").alias("nth", "value"))
    return found.filter("value IS NOT NULL")
