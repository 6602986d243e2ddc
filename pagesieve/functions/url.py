"""URL parts and reference resolution with built-in string functions.

The work is laid out as projections with named intermediate columns rather
than as one nested expression, so that each part is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.regex import quoted
from pagesieve.functions.text import WHITESPACE

# Schemes whose references can be relative, or carry an authority.
RELATIVE_SCHEMES = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]
AUTHORITY_SCHEMES = [
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https",
    "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh",
    "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services",
]
PARAMETER_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu",
    "sip", "sips", "mms", "sftp", "tel",
]
# Leading characters ignored, and characters removed anywhere.
CONTROL_OR_SPACE = "".join(chr(i) for i in range(33))
_DOT_SEGMENT = r"(?s)(?:^|/)\.\.?(?:/|$)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(url: Column) -> Column:
    """Authority of ``url`` with port and user information; empty when there is none."""
    return F.regexp_extract(
        F.ltrim(url, F.lit(CONTROL_OR_SPACE)), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1
    )


def before_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def clean_path(url: Column) -> Column:
    """URL up to the first ``?`` and then up to the first ``#``."""
    return F.substring_index(before_query(url), "#", 1)


def host_path(path_or_url: Column) -> Column:
    """Path without query and fragment, for reading names and extensions."""
    return F.substring_index(F.substring_index(path_or_url, "#", 1), "?", 1)


def _parts(url: str, p: str, default_scheme: str) -> list[str]:
    """SQL columns ``{p}s {p}n {p}p {p}q {p}f {p}m`` of ``url``, each using the ones before it.

    They are scheme, authority, path, query, fragment and parameters.  The path
    includes the parameters of its last segment; an empty parameter part is
    dropped with its separator.
    """
    control = quoted(CONTROL_OR_SPACE)
    known = f"CASE WHEN {p}s <> '' THEN {p}s ELSE {default_scheme} END"
    last = f"substring_index({p}w, '/', -1)"
    return [
        f"translate(ltrim({control}, {url}), '\\t\\r\\n', '') AS {p}u",
        f"lower(regexp_extract({p}u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS {p}s",
        f"if({p}s <> '', substring({p}u, length({p}s) + 2), {p}u) AS {p}r",
        f"substring_index({p}r, '#', 1) AS {p}h",
        f"substring({p}r, length({p}h) + 2) AS {p}f",
        f"substring_index({p}h, '?', 1) AS {p}b",
        f"substring({p}h, length({p}b) + 2) AS {p}q",
        f"if(startswith({p}b, '//'), substring_index(substring({p}b, 3), '/', 1), '') AS {p}n",
        f"if(startswith({p}b, '//'), substring({p}b, length({p}n) + 3), {p}b) AS {p}w",
        f"if(contains({last}, ';') AND {known} IN ({_list(PARAMETER_SCHEMES)}), "
        f"substring({last}, length(substring_index({last}, ';', 1)) + 1), '') AS {p}x",
        f"if({p}x = ';', substring({p}w, 1, length({p}w) - 1), {p}w) AS {p}p",
        f"if({p}x = ';', '', {p}x) AS {p}m",
    ]


def _list(values: list[str]) -> str:
    return ", ".join(quoted(v) for v in values)


def _build(s: str, n: str, path: str, q: str, f: str) -> str:
    lead = f"if({path} <> '' AND NOT startswith({path}, '/'), concat('/', {path}), {path})"
    return (
        f"concat(if({s} <> '', concat({s}, ':'), ''), "
        f"CASE WHEN {n} <> '' THEN concat('//', {n}, {lead}) "
        f"WHEN startswith({path}, '//') THEN concat('//', {path}) "
        f"WHEN {s} <> '' AND {s} IN ({_list(AUTHORITY_SCHEMES)}) AND ({path} = '' OR startswith({path}, '/')) "
        f"THEN concat('//', {path}) ELSE {path} END, "
        f"if({q} <> '', concat('?', {q}), ''), if({f} <> '', concat('#', {f}), ''))"
    )


def _resolved(path: str, rooted: str) -> str:
    """SQL that removes dot segments; only paths that hold any pay for it.

    Inner empty segments of a path merged with its base are dropped as well.
    """
    parts = f"split({path}, '/', -1)"
    inner = f"filter(slice({parts}, 2, greatest(size({parts}) - 2, 0)), x -> x <> '')"
    kept = (
        f"if(NOT {rooted} AND size({parts}) > 2, "
        f"concat(slice({parts}, 1, 1), {inner}, slice({parts}, -1, 1)), {parts})"
    )
    step = (
        "CASE WHEN x = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) "
        "WHEN x = '.' THEN acc ELSE concat(acc, array(x)) END"
    )
    done = f"aggregate({kept}, CAST(array() AS array<string>), (acc, x) -> {step})"
    closed = f"if(element_at({parts}, -1) IN ('.', '..'), concat({done}, array('')), {done})"
    messy = f"{path} RLIKE {quoted(_DOT_SEGMENT)} OR (NOT {rooted} AND contains({path}, '//'))"
    return f"coalesce(nullif(if({messy}, array_join({closed}, '/'), {path}), ''), '/')"


def with_join(df: DataFrame, url: str, base: str, out: str, *, fragment: bool = True) -> DataFrame:
    """Add ``out``: reference ``url`` resolved against ``base`` by the RFC 3986 rules.

    ``base`` may be a bare file path.  With ``fragment=False`` the result is
    rebuilt without its fragment, whatever the reference was.
    """
    keep = [c for c in df.columns if c != out]
    f = "_af" if fragment else "''"
    # path parameters take no part in resolution
    columns = [
        *_parts(base, "_z", "''"),
        *_parts(url, "_a", "_zs"),
        "if(_as <> '', _as, _zs) AS _s",
        "substring(_ap, 1, length(_ap) - length(_am)) AS _own",
        "startswith(_own, '/') AS _rooted",
        "if(_zp = '', '/', substring(_zp, 1, length(_zp) - length(substring_index(_zp, '/', -1)))) AS _dir",
        "if(_rooted, _own, concat(_dir, _own)) AS _merged",
        "if(_an <> '', _an, _zn) AS _site",
        "if(_an = '' AND _ap = '' AND _aq = '', _zq, _aq) AS _query",
        f"CASE WHEN _an <> '' THEN _ap WHEN _ap = '' THEN _zp ELSE concat({_resolved('_merged', '_rooted')}, _am) END AS _path",
        f"_s <> _zs OR _s NOT IN ({_list(RELATIVE_SCHEMES)}) AS _foreign",
    ]
    joined = _build("_s", "_site", "_path", "_query", f)
    if fragment:
        value = (
            f"CASE WHEN {base} = '' THEN {url} WHEN {url} = '' THEN {base} "
            f"WHEN _foreign THEN {url} ELSE {joined} END"
        )
    else:
        value = f"CASE WHEN {base} = '' OR _foreign THEN {_build('_as', '_an', '_ap', '_aq', f)} ELSE {joined} END"
    # The one-element generate keeps later filters on ``out`` above these projections;
    # pushed below, they would repeat the whole computation for every use of ``out``.
    return df.selectExpr("*", *columns).select(*keep, F.explode_outer(F.array(F.expr(value))).alias(out))


def with_normalized(df: DataFrame, url: str, base: str, out: str) -> DataFrame:
    """Add ``out``: ``url`` trimmed, without closing punctuation, absolute, without fragment.

    ``//host`` takes the scheme of the base; values that already start with http,
    https, ws or wss are only rebuilt.
    """
    # Punctuation dropped at the end, prefixes that are kept as they are.
    control = quoted(CONTROL_OR_SPACE)
    staged = df.selectExpr(
        "*",
        f"rtrim('.,;:', btrim({url}, {quoted(WHITESPACE)})) AS _t",
        f"lower(regexp_extract(ltrim({control}, {base}), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS _bs",
        "if(startswith(_t, '//'), concat(_bs, ':', _t), _t) AS _v",
        # resolving an absolute value against an empty base rebuilds it unchanged
        f"if(_v RLIKE '^(?:https?|wss?)://' OR _v = '', '', {base}) AS _base",
        f"if(_v = '', {base}, _v) AS _ref",
    )
    return with_join(staged, "_ref", "_base", out, fragment=False).drop("_t", "_bs", "_v", "_base", "_ref")
