"""Regular-expression entries and their translation to the JVM dialect.

Catalogs state every expression once, in the form the rules are specified in.
``jvm`` gives the text Spark evaluates: embedded flags that restore the
specified meaning of ``.``, ``\\w`` and case folding on the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rx:
    """One search expression.

    ``needs`` lists substrings of which every match contains at least one; it
    lets a plan skip the expression on texts that cannot match.  ``java`` is an
    equivalent spelling for the JVM, given only where the plain one would recurse
    per character or is not accepted there.  ``re2`` likewise for a linear-time
    engine (used by the SQL checks).
    """

    pattern: str
    needs: tuple[str, ...] = ()
    flags: str = ""
    java: str | None = None
    re2: str | None = None
    #: A stretch in which no match can begin once the expression has failed at its start; taking it
    #: in one step keeps long lines of unfinished openers from being searched again and again.
    idle: str | None = None
    #: A sign that ends a match and stands in no other part of it, what follows it in a match, and the expression for
    #: matches without it. Values are then sought between such signs, so that openers without an end are not searched from each.
    closer: tuple[str, str, str] | None = None

    @property
    def ignore_case(self) -> bool:
        return "i" in self.flags

    @property
    def groups(self) -> int:
        return _group_count(self.java or self.pattern)

    @property
    def value_group(self) -> int:
        """Group 1 when the expression has groups, else the whole match."""
        return 1 if self.groups else 0

    def jvm(self) -> str:
        # d: only \n ends a line; U: unicode-aware \w \d \s \b (and case folding with i)
        return f"(?dU{self.flags}){self.java or self.pattern}" + (f"|{self.idle}" if self.idle else "")


def _group_count(pattern: str) -> int:
    """Capturing groups: unescaped ``(`` outside a class that does not open ``(?``."""
    bare = re.sub(r"\\.", "x", pattern, flags=re.S)
    bare = re.sub(r"\[\^?\]?[^\]]*\]", "", bare)
    return len(re.findall(r"\((?!\?)", bare))


def quoted(text: str) -> str:
    """``text`` as a Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Signs that code is full of and prose is not; the first entry stands for either quote.
SIGNS = ["\"'", "(", "=", "{", ":", "/", "@", "`", "$", "_"]


def _required(parsed) -> set[str]:
    """Signs that every match of a parsed expression contains."""
    found: set[str] = set()
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            found |= {s for s in SIGNS if chr(arg) in s}
        elif name == "IN":
            members = {chr(v) if str(o) == "LITERAL" else None for o, v in arg}
            found |= {s for s in SIGNS if members <= set(s)}
        elif name == "SUBPATTERN":
            found |= _required(arg[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            found |= _required(arg[2])
        elif name == "BRANCH":
            found |= set.intersection(*[_required(a) for a in arg[1]])
    return found


def required_signs(rx: Rx) -> list[int]:
    """Positions in ``SIGNS`` of what any match must contain."""
    found = _required(_parser.parse(rx.pattern))
    return [k for k, s in enumerate(SIGNS) if s in found]


def _may_match(rx: Rx, text: str) -> str:
    """Cheap necessary condition for ``rx`` to match column ``text``, as SQL."""
    tests = [f"_sign{k}" for k in required_signs(rx)]
    where, words = ("_low", [n.lower() for n in rx.needs]) if rx.ignore_case else (text, rx.needs)
    known = {c for k in required_signs(rx) for c in SIGNS[k]}
    if words and not set(words) <= known:  # words that are just those signs are settled
        tests.append("(" + " OR ".join(f"contains({where}, {quoted(w)})" for w in words) + ")")
    return " AND ".join(tests) or "true"


def with_signs(df: DataFrame, text: str, rxs: list[Rx]) -> DataFrame:
    """Add what ``candidates`` reads: a few signs are looked for once per text and rule most expressions out of prose."""
    used = sorted({k for r in rxs for k in required_signs(r)})
    signs = {f"_sign{k}": reduce(or_, [F.contains(text, F.lit(c)) for c in SIGNS[k]]) for k in used}
    if any(r.ignore_case for r in rxs):
        signs["_low"] = F.lower(text)
    return df.withColumns(signs) if signs else df


def candidates(rxs: list[Rx], text: str) -> str:
    """SQL for the ordinals of the expressions that column ``text`` could match.

    Stated as text: one expression to hand over instead of thousands of small ones.
    """
    tests = ", ".join(f"CASE WHEN {_may_match(r, text)} THEN {k} END" for k, r in enumerate(rxs))
    return f"array_compact(array({tests}))"


def dispatch(ordinal: str, branches: list[str]) -> str:
    """SQL for ``branches[ordinal]``; only that branch is evaluated."""
    return f"CASE {ordinal} " + " ".join(f"WHEN {k} THEN {b}" for k, b in enumerate(branches)) + " END"


def lookup(ordinal: str, rows: list[dict[str, object]]) -> Column:
    """The constant row of a catalog at ``ordinal``, as a struct."""

    def value(v: object) -> str:
        return quoted(v) if type(v) is str else str(v)

    structs = ", ".join(
        "named_struct(" + ", ".join(f"'{n}', {value(v)}" for n, v in r.items()) + ")" for r in rows
    )
    return F.expr(f"get(array({structs}), {ordinal})")


def glob_to_regex(glob: str) -> str:
    """File-name glob (``*``, ``?``, ``[...]``) as an anchored expression."""
    out = ""
    rest = glob
    while rest:
        cls = re.match(r"\[(!?)(\]?[^\]]*)\]", rest)
        if rest[0] == "*":
            out, rest = out + ".*", rest[1:]
        elif rest[0] == "?":
            out, rest = out + ".", rest[1:]
        elif cls:
            body = cls.group(2).replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, rest = out + "[" + ("^" if cls.group(1) else "") + body + "]", rest[cls.end():]
        else:
            out, rest = out + re.escape(rest[0]), rest[1:]
    return f"(?s)^(?:{out})$"
