"""Column helpers for text: whitespace, lines, escaping, file names."""

from __future__ import annotations

from functools import reduce

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Line boundaries of a universal line splitter.
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
NON_NEWLINE_BREAK = r"[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def split_lines(c: Column) -> Column:
    """Lines by newline only, the unit of the line-local detectors."""
    return F.split(c, "\n")


# SQL for lines by any line boundary; the plain newline split covers nearly all texts.
UNIVERSAL_LINES = (
    "if({0} RLIKE '" + NON_NEWLINE_BREAK.replace("\\", "\\\\") + "', "
    "split({0}, '" + LINE_BREAKS.replace("\\", "\\\\") + "', -1), split({0}, '\\n', -1))"
)


def count_newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def clean_value(c: Column, max_length: int = 500) -> Column:
    """Strip, drop one pair of matching quotes, cut to ``max_length`` and mark the cut."""
    v = strip(c)
    first = F.substring(v, 1, 1)
    quoted = (F.length(v) >= 2) & first.isin('"', "'", "`") & (F.substring(v, -1, 1) == first)
    bare = F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return truncate(bare, max_length)


def truncate(c: Column, max_length: int) -> Column:
    return F.when(F.length(c) > max_length, F.concat(F.substring(c, 1, max_length), F.lit("..."))).otherwise(c)


def html_escape(c: Column) -> Column:
    # Escape table, ampersand first.
    table = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return reduce(lambda acc, t: F.replace(acc, F.lit(t[0]), F.lit(t[1])), table, c)


def html_unescape(c: Column) -> Column:
    """Decode the five markup entities; ampersand last so nothing is decoded twice."""
    table = [
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
        ("&apos;", "'"), ("&amp;", "&"),
    ]
    decoded = reduce(lambda acc, t: F.replace(acc, F.lit(t[0]), F.lit(t[1])), table, c)
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def strip_ansi(c: Column) -> Column:
    """Remove terminal control sequences."""
    # Fixed value: CSI sequence.
    return F.regexp_replace(c, "\x1b\\[[0-?]*[ -/]*[@-~]", "")


def safe_name(c: Column, default: str = "target") -> Column:
    """URL or host as a file name: no scheme, reserved runs to ``_``."""
    bare = F.regexp_replace(c, "^https?://", "")
    # Fixed value: characters reserved in file names.
    name = F.btrim(F.regexp_replace(bare, '[\\\\/:*?"<>|]+', "_"), F.lit("_"))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """Last extension with its dot, empty for dot-files and names without one."""
    return F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]+)$", 1)


_REFERENCE = r"(?s)[^&]+|&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|&"
_REPLACED = "\ufffd"


def _character(code: Column) -> Column:
    """The character that a numeric reference stands for."""
    odd = {0x80 + i: bytes([0x80 + i]).decode("cp1252", "ignore") or chr(0x80 + i) for i in range(32)} | {0: _REPLACED}
    out = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    out = F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit(_REPLACED)).otherwise(out)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in odd.items() for x in pair]), code), out)


def decode_references(c: Column) -> Column:
    """Text with all named and numeric character references decoded.

    A name counts as a whole, with its semicolon or without one if it is known without.
    """
    names = F.from_json(F.lit(json.dumps({f"&{n}": v for n, v in html5.items()})), "map<string,string>")

    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, "^&#0*([0-9]{1,7});?$", 1)
        hexes = F.regexp_extract(part, "^&#[xX]0*([0-9a-fA-F]{1,6});?$", 1)
        code = F.when(digits != "", digits.cast("int")).when(hexes != "", F.conv(hexes, 16, 10).cast("int"))
        code = F.when(part.rlike("^&#[xX]?0+;?$"), F.lit(0)).when(part.rlike("^&#"), F.coalesce(code, F.lit(0x110000)))
        named = F.coalesce(F.try_element_at(names, part), part)
        return F.when(~F.startswith(part, F.lit("&")), part).when(F.startswith(part, F.lit("&#")) & (F.length(part) > 2), _character(code)).otherwise(named)

    decoded = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0)), one), "")
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)
