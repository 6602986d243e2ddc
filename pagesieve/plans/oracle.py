"""DuckDB SQL for the registered queries.

Written from the catalogs but worked out another way than the Spark plans: match
positions come from splitting the text and window sums, lines and columns from
the text ahead of a match.
"""

from __future__ import annotations

from pagesieve.catalog.endpoint_types import (
    CONTEXT_WINDOW,
    ENDPOINT_TYPES,
    METHOD,
    METHOD_WINDOW,
    REJECT_AT_START,
    STATIC_ASSET,
)
from pagesieve.catalog.js_categories import CATEGORIES, CONFIDENCE_RANK, detectors
from pagesieve.catalog.languages import BY_KEY, EXCLUDED_DIRS, LANGUAGES, block_markers, line_markers, token
from pagesieve.catalog.vuln_rules import GROUPS, SEVERITY_RANK, TAINT_HINTS, WITH_RULE, rules
from pagesieve.functions.regex import Rx, glob_to_regex
from pagesieve.functions.text import WHITESPACE
from pagesieve.operators.responses import BUCKETS, DEFAULT_OK
from pagesieve.operators.urls import (
    DOMAIN_NAME,
    IMPORTANT_PATH,
    QUERY_NAME,
    URL_CATEGORIES,
    scope_patterns,
)
from pagesieve.plans.derived import SCOPE, TABLES
from pagesieve.sources.reports import TITLES

ORACLE: dict[str, str] = {}
NL = "chr(10)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WS = " || ".join([lit("".join(c for c in WHITESPACE if c.isprintable() and c == " ") or "")] + [
    f"chr({ord(c)})" for c in WHITESPACE if c != " "])


def strip(c: str) -> str:
    return f"trim({c}, {_WS})"


def re2(rx: Rx) -> str:
    flags = rx.flags
    return lit((f"(?{flags})" if flags else "") + (rx.re2 or rx.pattern))


def tab(name: str) -> str:
    return f"({TABLES[name][0]})"


PAGES_AS_CORPUS = "(SELECT url || '.html' AS path, html AS content FROM pages)"
DOCS = "(SELECT 'doc/' || doc_id AS path, text AS content FROM documents)"
JS = f"(SELECT path, content FROM {tab('js_corpus')})"
BOTH = f"(SELECT * FROM {JS} UNION ALL SELECT * FROM {PAGES_AS_CORPUS})"
DOCS_JS = f"(SELECT * FROM {DOCS} UNION ALL SELECT * FROM {JS})"


# --- matches with positions ------------------------------------------------------------------


def matches(corpus: str, rx: Rx, extra: str = "") -> str:
    """path, content, nth, off, line, col, hit, value, nxt (text up to the next match)."""
    p = re2(rx)
    inner = (
        f"SELECT path, content, regexp_extract_all(content, {p}, 0) AS hits, "
        f"regexp_extract_all(content, {p}, {rx.value_group if not rx.re2 else 0}) AS vals, string_split_regex(content, {p}) AS gaps "
        f"FROM {corpus} WHERE regexp_matches(content, {p})"
    )
    rows = (
        "SELECT path, content, unnest(hits) AS hit, unnest(vals) AS value, unnest(gaps[1:len(hits)]) AS gap, "
        f"unnest(gaps[2:]) AS nxt, unnest(range(len(hits))) AS nth FROM ({inner})"
    )
    off = (
        "sum(length(gap)) OVER (PARTITION BY path ORDER BY nth) + "
        "coalesce(sum(length(hit)) OVER (PARTITION BY path ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    )
    return (
        f"SELECT *, CAST(length(ahead) - length(replace(ahead, {NL}, '')) + 1 AS INTEGER) AS line, "
        f"CAST(length(string_split(ahead, {NL})[-1]) + 1 AS INTEGER) AS col{extra} "
        f"FROM (SELECT *, left(content, off) AS ahead FROM (SELECT *, CAST({off} AS INTEGER) AS off FROM ({rows})))"
    )


# --- URL resolution ----------------------------------------------------------------------------

_URL = "'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$'"


def join(rel: str, url: str, base: str, fragment: bool) -> str:
    """``rel`` with a column ``joined``: http-like references and bases only."""
    part = lambda c, k: f"coalesce(regexp_extract({c}, {_URL}, {k}), '')"
    has_q = f"regexp_matches({url}, '^[^#]*[?]')"
    frag = f"CASE WHEN {part(url, 5)} <> '' THEN '#' || {part(url, 5)} ELSE '' END" if fragment else "''"
    folder = "CASE WHEN bp = '' THEN '/' ELSE regexp_extract(bp, '^(.*/)?', 0) END"
    dots = "merged"
    dots = f"CASE WHEN rooted THEN {dots} ELSE regexp_replace({dots}, '(.)/{{2,}}', '\\1/', 'g') END"
    for _ in range(4):
        dots = f"regexp_replace({dots}, '(^|/)[.](/|$)', '\\1')"
    for _ in range(4):
        dots = f"regexp_replace({dots}, '(^|/)([^/.]|[.][^/.]|[^/.][^/]+|[.][.][^/]+)/[.][.](/|$)', '\\1')"
    for _ in range(2):
        dots = f"regexp_replace({dots}, '^(/?)[.][.](/|$)', '\\1')"
    query = f"CASE WHEN up = '' AND un = '' AND NOT {has_q} THEN bq ELSE uq END"
    return f"""
SELECT *, CASE WHEN {url} = '' THEN {base} WHEN us <> '' THEN us || ':' || CASE WHEN un <> '' THEN '//' || un ELSE '' END || up
   || CASE WHEN uq <> '' THEN '?' || uq ELSE '' END || {frag}
  ELSE CASE WHEN bs <> '' THEN bs || ':' ELSE '' END
   || CASE WHEN un <> '' THEN '//' || un || up WHEN bn <> '' THEN '//' || bn || rpath ELSE rpath END
   || CASE WHEN q <> '' THEN '?' || q ELSE '' END || {frag} END AS joined
FROM (SELECT *, {query} AS q, CASE WHEN up = '' THEN bp ELSE coalesce(nullif({dots}, ''), '/') END AS rpath
 FROM (SELECT *, CASE WHEN rooted THEN up ELSE {folder} || up END AS merged
  FROM (SELECT *, lower({part(url, 1)}) AS us, {part(url, 2)} AS un, regexp_replace({part(url, 3)}, ';$', '') AS up, {part(url, 4)} AS uq,
    lower({part(base, 1)}) AS bs, {part(base, 2)} AS bn, {part(base, 3)} AS bp, {part(base, 4)} AS bq,
    starts_with({part(url, 3)}, '/') AS rooted FROM ({rel}))))"""


def normalized(rel: str, url: str, base: str) -> str:
    trimmed = f"rtrim({strip(url)}, '.,;:')"
    scheme = f"coalesce(regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1), '')"
    staged = (
        f"SELECT *, CASE WHEN starts_with(_t, '//') THEN {scheme} || ':' || _t WHEN _t = '' THEN '' ELSE _t END AS _v "
        f"FROM (SELECT *, {trimmed} AS _t FROM ({rel}))"
    )
    # '://host' on a base without scheme is a path of its own
    return join(f"SELECT *, CASE WHEN _v = '' THEN '?' || coalesce(regexp_extract({base}, '[?](.*)$', 1), '') ELSE _v END AS _u FROM ({staged})",
                "_u", base, False)


def valid(v: str) -> str:
    reject = "^(?:" + "|".join(f"(?:{p})" for p in REJECT_AT_START) + ")"
    return (
        f"(length({strip(v)}) >= 2 AND (contains({v}, '/') OR starts_with({strip(v)}, 'http') OR starts_with({strip(v)}, 'ws')) "
        f"AND NOT regexp_matches({strip(v)}, {lit(reject)}))"
    )


def endpoints(corpus: str, types: list[str] | None = None) -> str:
    """All endpoint columns over ``corpus(path, content)``."""
    parts = []
    for k, (name, rx) in enumerate(ENDPOINT_TYPES):
        if types is None or name in types:
            around = f"substr(content, greatest(off - {CONTEXT_WINDOW} + 1, 1), least(off, {CONTEXT_WINDOW}) + length(hit) + {CONTEXT_WINDOW})"
            parts.append(
                f"SELECT path, value, line, off, {k} AS ord, {lit(name)} AS type, replace({around}, {NL}, ' ') AS context, "
                f"right(ahead, {METHOD_WINDOW}) AS near FROM ({matches('corpus', rx)}) WHERE {valid('value')}"
            )
    found = " UNION ALL ".join(parts)
    rx = lit(f"(?i){METHOD}")
    method = f"upper(coalesce(nullif(regexp_extract(near, {rx}, 1), ''), nullif(regexp_extract(near, {rx}, 3), '')))"
    return (
        f"WITH corpus AS MATERIALIZED (SELECT path, content FROM {corpus}) SELECT path AS source_file, joined AS url, "
        f"line AS line_number, context, {method} AS method, type AS endpoint_type, CAST(ord AS INTEGER) AS pattern_ord, "
        f"off AS \"offset\" FROM ({normalized(found, 'value', 'path')}) WHERE {valid('joined')}"
    )


# --- items ---------------------------------------------------------------------------------------


def clean(v: str, width: int = 500) -> str:
    s = strip(v)
    bare = (
        f"CASE WHEN length({s}) >= 2 AND left({s}, 1) IN ('\"', '''', '`') AND right({s}, 1) = left({s}, 1) "
        f"THEN substr({s}, 2, length({s}) - 2) ELSE {s} END"
    )
    return cut(f"({bare})", width)


def cut(v: str, width: int) -> str:
    return f"CASE WHEN length({v}) > {width} THEN left({v}, {width}) || '...' ELSE {v} END"


def items(corpus: str, categories: list[str] | None = None, min_length: int = 3,
          custom: list[tuple[str, str, str]] | None = None) -> str:
    chosen = [c for c in CATEGORIES if categories is None or c in categories]
    parts, whole = [], []
    table = [(c, CATEGORIES.index(c), k, rx, conf) for c in chosen if c != "comments" for k, (rx, conf) in enumerate(detectors(c))]
    table += [("custom_patterns", len(CATEGORIES), k, Rx(rx, (), "s"), conf or "medium") for k, (_, rx, conf) in enumerate(custom or [])]
    for c, co, k, rx, conf in table:
        if c == "function_names" and "\\1" in rx.pattern:
            continue  # its value is one quote, always too short
        parts.append(
            f"SELECT path, line_number, around, {lit(c)} AS category, {co} AS co, {k} AS k, {lit(conf)} AS confidence, "
            f"unnest(v) AS raw, unnest(range(len(v))) AS nth FROM (SELECT *, regexp_extract_all(line, {re2(rx)}, {rx.value_group}) AS v "
            f"FROM lines WHERE regexp_matches(line, {re2(rx)}))"
        )
    for k, (rx, conf) in enumerate(detectors("comments")):
        if "comments" in chosen:
            v = cut(strip("hit"), 500)
            whole.append(
                f"SELECT path, 'comments' AS category, {v} AS value, line AS line_number, {cut('(' + v + ')', 200)} AS context, "
                f"{lit(conf)} AS confidence, {CATEGORIES.index('comments')} AS co, {k} AS k, nth FROM ({matches('corpus', rx)})"
            )
    out = []
    if parts:
        out.append(
            f"SELECT path, category, value, line_number, {strip('around')} AS context, confidence, co, k, nth "
            f"FROM (SELECT *, {clean('raw')} AS value FROM ({' UNION ALL '.join(parts)})) WHERE length(value) >= {min_length}"
        )
    out += whole
    split = (
        f"SELECT path, line, CAST(n AS INTEGER) AS line_number, concat_ws({NL}, lag(line) OVER w, line, lead(line) OVER w) AS around "
        f"FROM (SELECT path, unnest(string_split(content, {NL})) AS line, generate_subscripts(string_split(content, {NL}), 1) AS n FROM corpus) "
        "WINDOW w AS (PARTITION BY path ORDER BY n)"
    )
    return (
        f"WITH corpus AS MATERIALIZED (SELECT path, content FROM {corpus} WHERE {strip('content')} <> ''), "
        f"lines AS MATERIALIZED ({split}) SELECT path, category, value, CAST(line_number AS INTEGER) AS line_number, context, confidence, "
        f"CAST(co AS INTEGER) AS category_ord, CAST(k AS INTEGER) AS pattern_ord, CAST(nth AS INTEGER) AS match_ord FROM ({' UNION ALL '.join(out)})"
    )


_IT = "path, category, value, line_number, confidence"
_CONF = "CASE confidence " + " ".join(f"WHEN '{c}' THEN {r}" for c, r in CONFIDENCE_RANK.items()) + " ELSE 99 END"


# --- findings --------------------------------------------------------------------------------------

_AHEAD = f"string_split(nxt, {NL})[1]"
# What a linear-time engine cannot look ahead for is tested on the rest of the line.
_KEEP = {
    "JS-COOKIE-INSECURE-001": f"NOT regexp_matches({_AHEAD}, '(?i)secure|httponly|samesite')",
    "JS-JWT-NONE-ALG-001": f"NOT (starts_with(hit, 'jwt.decode') AND contains({_AHEAD}, 'verify'))",
    "JS-HTTP-INSECURE-URL-001": "NOT regexp_matches(hit, '^.http://(localhost|127[.]0[.]0[.]1)')",
}


def findings(corpus: str, groups: list[str] | None = None, include_info: bool = True) -> str:
    order = [r.rule_id for r in rules()]
    hints = "|".join(h.replace(".", "[.]") for h in TAINT_HINTS)
    parts = []
    for r in rules(groups, include_info):
        keep = [_KEEP.get(r.rule_id, "true")]
        if r.below:
            n = [f"CAST(regexp_extract(hit, '([0-9]+)[.]([0-9]+)[.]([0-9]+)$', {k}) AS BIGINT)" for k in (1, 2, 3)]
            keep.append(f"({', '.join(n)}) < ({', '.join(map(str, r.below))})")
        if r.taint:
            keep.append(f"regexp_matches(array_to_string(string_split(content, {NL})[greatest(line - 4, 1):line + 5], {NL}), '{hints}')")
        parts.append(
            f"SELECT {lit(r.rule_id)} AS rule_id, {lit(r.severity)} AS severity, path AS file, line, col AS \"column\", "
            f"left({strip(f'string_split(content, {NL})[line]')}, 200) AS snippet, {order.index(r.rule_id)} AS rule_ord, off AS \"offset\" "
            f"FROM ({matches('corpus', r.rx)}) WHERE {' AND '.join(keep)}"
        )
    return f"WITH corpus AS MATERIALIZED (SELECT path, content FROM {corpus}) {' UNION ALL '.join(parts)}"


_FI = 'rule_id, severity, file, line, "column", snippet'
_RULES = "(VALUES " + ", ".join(
    f"({lit(r.rule_id)}, {lit(r.title)}, {lit(r.description)}, {lit(r.remediation)}, {lit(r.cwe)}, {lit(','.join(r.tags))})"
    for r in [*rules(), WITH_RULE]) + ") AS r(rid, title, description, remediation, cwe, tags)"
_RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in SEVERITY_RANK.items()) + " END"


# --- comments ----------------------------------------------------------------------------------------

_NAME = "lower(string_split(path, '/')[-1])"
_EXT = f"coalesce(regexp_extract({_NAME}, '^[.]*[^.].*?([.][^.]+)$', 1), '')"
_LANG = "CASE " + " ".join(
    [f"WHEN {_NAME} IN ({', '.join(sorted({lit(f.lower()) for f in g.filenames}))}) THEN {lit(g.key)}" for g in LANGUAGES if g.filenames]
    + [f"WHEN {_EXT} IN ({', '.join(lit(e) for e in g.extensions)}) THEN {lit(g.key)}" for g in LANGUAGES]) + " END"


def comments(corpus: str, languages: list[str] | None = None) -> str:
    parts = []
    for g in LANGUAGES:
        if languages is not None and g.key not in languages:
            continue
        rx = token(g)
        if any(m.isalnum() for m in g.line):  # a word marker: consume other words whole
            rx = Rx(rx.pattern + r"|[\p{L}\p{N}_]+")
        rx = Rx(rx.pattern)
        marks = [(s, e, "block") for s, e in block_markers(g)] + [(m, "", "line") for m in line_markers(g)]
        case = lambda f: "CASE " + " ".join(f"WHEN starts_with(hit, {lit(s)}) THEN {f(s, e, t)}" for s, e, t in marks) + " END"  # noqa: E731,B023
        opened = case(lambda s, e, t: str(len(s)))
        close = case(lambda s, e, t: f"CASE WHEN ends_with(hit, {lit(e)}) AND length(hit) >= {len(s) + len(e)} THEN {len(e)} ELSE 0 END" if e else "0")
        kind = case(lambda s, e, t: lit(t))
        parts.append(
            f"SELECT path, {lit(g.name)} AS language, line, off, hit, {opened} AS opened, {close} AS closed, {kind} AS type "
            f"FROM ({matches(f'(SELECT * FROM corpus WHERE lang = {lit(g.key)})', rx)})"
        )
    return (
        f"WITH corpus AS MATERIALIZED (SELECT path, content, {_LANG} AS lang FROM {corpus}) "
        "SELECT path, language, line AS line_start, CAST(line + CASE WHEN type = 'block' THEN length(hit) - length(replace(hit, chr(10), '')) ELSE 0 END AS INTEGER) AS line_end, "
        f"{strip('substr(hit, opened + 1, length(hit) - opened - closed)')} AS text, type, off AS \"offset\" FROM ({' UNION ALL '.join(parts)}) "
        f"WHERE opened IS NOT NULL AND (length(hit) > opened OR (type = 'block' AND closed > 0) OR (type = 'line' AND ends_with(hit, {NL})))"
    )


_CO = "path, language, line_start, line_end, text, type"
_TITLES = "CASE lang " + " ".join(f"WHEN {lit(g.key)} THEN {lit(g.name)}" for g in LANGUAGES) + " END"

# --- HTML ------------------------------------------------------------------------------------------

_AT = """(?:[^>"']|"[^"]*"|'[^']*')*"""
_TOKEN = lit(
    "(?s)<!--.*?-->" + rf"|<(?i:script)(?:[\s/]{_AT})?>.*?</(?i:script)[^>]*>" + rf"|<(?i:style)(?:[\s/]{_AT})?>.*?</(?i:style)[^>]*>"
    + rf"|<[a-zA-Z]{_AT}>")
_TAGS = (
    f"SELECT page_url, n, tok, lower(regexp_extract(tok, '^<([a-zA-Z][^[:space:]/>]*)', 1)) AS tag, "
    f"regexp_extract(tok, {lit('^<[a-zA-Z]' + _AT + '>')}, 0) AS opened FROM (SELECT url AS page_url, unnest(t) AS tok, "
    f"unnest(range(len(t))) AS n FROM (SELECT url, regexp_extract_all(html, {_TOKEN}, 0) AS t FROM {tab('rich_pages')}))"
)


def attribute(name: str) -> str:
    rx = lit(rf"""(?i)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']*)""")
    raw = f"regexp_extract(opened, {rx}, 1)"
    bare = f"trim({raw}, '\"''')"
    for a, b in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&eacute;", "é"), ("&#47;", "/"), ("&#xe9;", "é"), ("&#61;", "="), ("&nbsp;", "\u00a0"), ("&amp;", "&")]:
        bare = f"replace({bare}, {lit(a)}, {lit(b)})"
    return f"CASE WHEN regexp_matches(opened, {rx}) THEN {bare} END"


_SOURCES = f"SELECT page_url, {attribute('src')} AS v FROM ({_TAGS}) WHERE tag = 'script'"
_SCRIPTS = f"SELECT DISTINCT page_url, joined AS script_url FROM ({join(_SOURCES, 'v', 'page_url', True)}) WHERE v IS NOT NULL"
_BODY = f"regexp_extract(substr(tok, length(opened) + 1), '(?is)^(.*)</script[^>]*>$', 1)"
_INLINE = f"SELECT page_url, {_BODY} AS content FROM ({_TAGS}) WHERE tag = 'script' AND {_BODY} <> ''"
_HANDLERS = " UNION ALL ".join(
    f"SELECT page_url, n, tag, '{a}' AS attribute, {attribute(a)} AS content FROM ({_TAGS}) WHERE tag IN ('a', 'form', 'button', 'input', 'div', 'span')"
    for a in ["onclick", "onload", "onerror", "onmouseover"])
_HANDLERS = f"SELECT * FROM ({_HANDLERS}) WHERE content IS NOT NULL AND content <> ''"
_LINKS = join(
    f"SELECT page_url, n, v FROM (SELECT page_url, n, {attribute('href')} AS v FROM ({_TAGS}) WHERE tag = 'a') "
    "WHERE v IS NOT NULL AND v <> '' AND NOT regexp_matches(v, '^(#|javascript:|mailto:|tel:)')", "v", "page_url", True)
_SITE = lambda c: f"regexp_extract({c}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
_INTERNAL = f"SELECT page_url, joined AS link_url FROM ({_LINKS}) WHERE {_SITE('joined')} = {_SITE('page_url')}"


def put(name: str, sql: str) -> None:
    ORACLE[name] = sql


def build() -> None:
    js, src, urls, resp = JS, tab("source_corpus"), tab("urls"), tab("responses")
    # sources and sinks
    put("pages_corpus", "SELECT url AS path, html AS content, 'html' AS kind FROM pages")
    put("scan_corpus", "SELECT 'src' AS folder, 'text' AS kind, page_id || ' ' || url AS line FROM pages WHERE page_id % 5 <> 0")
    title = "regexp_extract(html, '<title>([^<]*)', 1)"
    put("decode_text", f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN {title} ELSE chr(233) || regexp_replace({title}, '[^ -~]', '', 'g') END AS content FROM pages WHERE page_id % 3 < 2")
    put("list_source", "SELECT trim(url) AS value FROM pages WHERE page_id % 4 <> 0 AND page_id % 5 <> 0")
    put("sourcemap_explode", "SELECT url || '.js.map -> a.js' AS path, url AS content, 'js' AS kind FROM pages WHERE page_id % 7 <> 0 UNION ALL SELECT url || '.js.map -> b.js', 'x=1;', 'js' FROM pages WHERE page_id % 7 <> 0 AND page_id % 2 <> 0")
    put("response_log_parse", f"SELECT DISTINCT url, status, length, 'h1' AS hash FROM {resp} WHERE length <> '512'")
    put("sink_json_roundtrip", f'SELECT rule_id, file, line, "column", snippet FROM ({findings(js)})')
    put("sink_csv_roundtrip", f"SELECT {_IT} FROM ({items(js)})")
    put("report_lines", f"""SELECT '[' || severity || '] ' || rule_id || '  ' || title || {NL} || '   File : ' || file || ':' || line || ':' || "column"
 || {NL} || '   CWE  : ' || cwe || '    Tags: ' || replace(tags, ',', ', ') || CASE WHEN snippet <> '' THEN {NL} || '   Code : ' || snippet ELSE '' END
 || {NL} || '   Fix  : ' || remediation AS block FROM ({findings(js)}) JOIN {_RULES} ON rid = rule_id""")
    ep = endpoints(js)
    put("endpoint_lines", f"SELECT CASE WHEN method IS NOT NULL THEN '[' || method || '] ' ELSE '' END || url || '  (' || source_file || ':' || line_number || ')' AS line FROM ({ep})")
    put("item_lines", f"SELECT '- `' || value || '` (Line ' || line_number || ', ' || confidence || ')' AS line FROM ({items(js)})")
    co = comments(src)
    put("comment_lines", f"SELECT '  [' || CASE type WHEN 'line' THEN 'LINE ' ELSE 'BLOCK' END || ' L' || line_start || CASE WHEN line_end <> line_start THEN '-L' || line_end ELSE '' END || '] ' || text AS line FROM ({co})")
    fi = findings(js)
    put("severity_line", "SELECT string_agg(severity || '=' || n, ', ' ORDER BY r DESC) AS line FROM (SELECT severity, count(*) AS n, "
        f"{_RANK} AS r FROM ({fi}) GROUP BY severity)")
    put("comment_lang_slug", f"SELECT language, trim(regexp_replace(lower(language), '[^a-z0-9]+', '_', 'g'), '_') AS lang_slug, count(*) AS n FROM ({co}) GROUP BY 1, 2")
    cats = " UNION ALL ".join(f"SELECT {lit(c)} AS category, url FROM {urls} WHERE regexp_matches(url, {lit('(?i)' + rx)})" for c, rx in URL_CATEGORIES.items())
    put("sink_url_categories", cats)
    # whole reports: blocks are joined in order and split into numbered lines
    def report(name: str, blocks: str, given: str = "") -> None:
        whole = f"SELECT string_split(string_agg(line, {NL} ORDER BY part, section, a, b, c, nth, line), {NL}) AS l FROM ({blocks})"
        put(name, f"{given} SELECT CAST(unnest(generate_series(0, len(l) - 1)) AS BIGINT) AS nr, unnest(l) AS line FROM ({whole})")

    def block(part: int, section: str, line: str, tail: str = "", a: str = "0", b: str = "0", c: str = "0", nth: str = "0") -> str:
        return f"SELECT {part} AS part, {section} AS section, {a} AS a, {b} AS b, {c} AS c, {nth} AS nth, {line} AS line {tail}"

    bar, thin = "repeat('=', 78)", "repeat('-', 78)"
    own = f"""'[' || severity || '] ' || rule_id || '  ' || title || {NL} || '   File : ' || file || ':' || line || ':' || "column"
 || {NL} || '   CWE  : ' || cwe || '    Tags: ' || replace(tags, ',', ', ') || CASE WHEN snippet <> '' THEN {NL} || '   Code : ' || snippet ELSE '' END
 || {NL} || '   Fix  : ' || remediation || {NL}"""
    report("report_findings", " UNION ALL ".join([
        block(0, "''", f"{bar} || {NL} || ' Findings in scripts: ' || (SELECT count(*) FROM f) || {NL} || {bar} || {NL} || ' Severity breakdown: ' || (SELECT string_agg(severity || '=' || n, ', ' ORDER BY r DESC) "
              f"FROM (SELECT severity, count(*) AS n, {_RANK} AS r FROM f GROUP BY severity)) || {NL} || {thin}"),
        block(1, f"CAST(9 - {_RANK} AS VARCHAR) || file", own, f"FROM f JOIN {_RULES} ON rid = rule_id", "line", "rule_ord", '"offset"'),
    ]), f"WITH f AS MATERIALIZED ({fi})")
    ranks = "list_position([" + ", ".join(lit(c) for c in CATEGORIES) + "], category)"
    named = "CASE category " + " ".join(f"WHEN {lit(c)} THEN {lit(t)}" for c, t in TITLES.items()) + " ELSE category END"
    report("report_items", " UNION ALL ".join([
        block(0, "''", f"'# Items of scripts' || {NL} || {NL} || '**Files Analyzed:** ' || (SELECT count(*) FROM {js}) || {NL}"),
        block(1, "path", f"{NL} || '## ' || path || {NL}", f"FROM {js}", "-1"),
        block(1, "path", f"'### ' || {named} || {NL}", "FROM (SELECT DISTINCT path, category FROM i)", ranks, "-1"),
        block(1, "path", "'- `' || value || '` (Line ' || line_number || ', ' || confidence || ')'", "FROM i", ranks, "line_number", "pattern_ord", "match_ord"),
        block(1, "path", "''", "FROM (SELECT DISTINCT path, category FROM i)", ranks, "1000000"),
    ]), f"WITH i AS MATERIALIZED ({items(js)})")
    bar, thin = "repeat('=', 72)", "repeat('-', 72)"
    span = "'L' || line_start || CASE WHEN line_end <> line_start THEN '-L' || line_end ELSE '' END"
    shown = f"array_to_string(list_transform(string_split(text, {NL}), lambda x: '    ' || x || {NL} || {thin}), {NL})"
    report("report_comments", " UNION ALL ".join([
        block(0, "''", f"{bar} || {NL} || '  COMMENTS' || {NL} || {bar} || {NL} || 'Source path         : sources' || {NL} || 'Files scanned       : ' || (SELECT count(*) FROM {src}) || {NL} || "
              f"'Files with comments : ' || (SELECT count(DISTINCT path) FROM k) || {NL} || 'Total comments      : ' || (SELECT count(*) FROM k) || {NL} || {bar} || {NL}"),
        block(1, "path", f"{thin} || {NL} || 'FILE     : ' || path || {NL} || 'LANGUAGE : ' || language || {NL} || 'COMMENTS : ' || count(*) || {NL} || {thin}", "FROM k GROUP BY path, language", "-1"),
        block(1, "path", f"'  [' || CASE type WHEN 'line' THEN 'LINE ' ELSE 'BLOCK' END || ' ' || {span} || ']' || {NL} || {shown} || {NL}", "FROM k", '"offset"'),
        block(1, "path", "''", "FROM (SELECT DISTINCT path FROM k)", "1000000000"),
    ]), f"WITH k AS MATERIALIZED ({co})")
    array = f'SELECT CAST(row_number() OVER (ORDER BY {_RANK} DESC, file, line, rule_ord, "offset") - 1 AS INTEGER) AS nr, rule_id, file, line, "column", snippet FROM f'
    put("sink_json_array", f"WITH f AS MATERIALIZED ({fi}) {array}")
    put("sink_json_document", f"WITH f AS MATERIALIZED ({fi}) SELECT 'pagesieve' AS tool, (SELECT count(DISTINCT file) FROM f) AS files_analyzed, "
        f"(SELECT count(*) FROM f) AS total_findings, true AS dated, * FROM ({array})")
    # HTML
    put("html_script_src", _SCRIPTS)
    put("html_inline_scripts", _INLINE)
    ep_cols = "source_file, url, line_number, endpoint_type"
    # a path may hold several scripts: number them so that positions stay apart
    tagged = lambda q: f"(SELECT page_url || chr(1) || row_number() OVER () AS path, content FROM ({q}))"
    untag = "string_split(source_file, chr(1))[1] AS source_file"
    put("html_inline_endpoints", f"SELECT {untag}, url, line_number, endpoint_type FROM ({endpoints(tagged(_INLINE))})")
    put("html_event_attrs", f"SELECT page_url, tag, attribute, content FROM ({_HANDLERS})")
    put("html_event_endpoints", f"SELECT {untag}, url, endpoint_type FROM ({endpoints(tagged(_HANDLERS))})")
    put("html_links", f"SELECT page_url, v AS href, joined AS link_url FROM ({_LINKS})")
    put("html_internal_links", _INTERNAL)
    edges = tab("link_edges")
    put("link_reach", f"WITH RECURSIVE w(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, depth + 1 FROM w JOIN {edges} ON src = node WHERE depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node")
    put("reached_scripts", f"WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT page_url, link_url FROM ({_INTERNAL})), "
        "w(node, depth) AS (SELECT url, 0 FROM pages WHERE page_id % 10 = 0 UNION SELECT link_url, depth + 1 FROM w JOIN e ON page_url = node WHERE depth < 2) "
        f"SELECT DISTINCT script_url FROM ({_SCRIPTS}) WHERE page_url IN (SELECT node FROM w)")
    # endpoints
    for name, _ in ENDPOINT_TYPES:
        put(f"ep_{name}", f"SELECT {ep_cols} FROM ({endpoints(js, [name])})")
    put("endpoints_all", f"SELECT * FROM ({endpoints(BOTH)})")
    v = strip("value")
    put("ep_valid_filter", f"SELECT value, {valid('value')} AS ok, {valid('value')} AND NOT regexp_matches({v}, {lit(STATIC_ASSET)}) AS ok_no_assets FROM (SELECT DISTINCT unnest(regexp_extract_all(content, '[\"''`]([^\"''`' || {NL} || ']*)[\"''`]', 1)) AS value FROM {js})")
    forms = ["'/root/' || p || '?a=1#f'", "'../up/' || p || '.js'", "'./here/../' || p || '/'", "'//cdn' || p || '.example.com/x?y=/z'", "'a//b/./c' || p || '.,;'",
             "'?only=query'", "'#frag'", "' /trim/.. '", "'https://abs.example.com/k#z'", "'wss://abs.example.com'", "''"]
    bases = "CASE p % 3 WHEN 0 THEN 'src/lib/f' || p || '.js' WHEN 1 THEN 'app.js' ELSE 'https://h' || p || '.example.com/d1/d2/f.js?v=1' END"
    refs = " UNION ALL ".join(f"SELECT p AS page_id, CAST({k} AS INTEGER) AS form, {bases} AS base, {f} AS ref FROM (SELECT page_id AS p FROM pages)" for k, f in enumerate(forms))
    put("url_normalize", f"SELECT page_id, form, base, joined AS resolved FROM ({normalized(refs, 'ref', 'base')})")
    put("url_join", f"SELECT page_id, form, base, joined AS resolved FROM ({join(refs, 'ltrim(ref)', 'base', True)})")
    for q, cols in [("ep_line_numbers", "line_number"), ("ep_context", "context"), ("ep_method", "method")]:
        put(q, f'SELECT source_file, pattern_ord, "offset", {cols} FROM ({ep})')
    dedup = f"""SELECT * FROM ({ep}) QUALIFY row_number() OVER (PARTITION BY string_split(url, '?')[1] ORDER BY source_file, pattern_ord, "offset") = 1"""
    put("ep_dedup", dedup)
    put("ep_filter", f"SELECT {ep_cols} FROM ({dedup}) WHERE regexp_matches(url, '(?i)/(API|rest)/')")
    put("ep_type_counts", f"SELECT endpoint_type, count(*) AS n FROM ({ep}) GROUP BY 1")
    put("ep_method_counts", f"SELECT coalesce(method, 'Unknown') AS method, count(*) AS n FROM ({ep}) GROUP BY 1")
    put("ep_file_counts", f"SELECT source_file, count(*) AS n FROM ({ep}) GROUP BY 1")
    # items
    for c in CATEGORIES:
        put(f"js_{c}", f"SELECT {_IT} FROM ({items(DOCS_JS if c in ('secrets', 'emails', 'ip_addresses') else js, [c])})")
    put("js_items_all", f"SELECT {_IT}, pattern_ord, match_ord FROM ({items(DOCS_JS)})")
    put("js_custom", f"SELECT {_IT} FROM ({items(js, [], custom=[('track', 'ref=([0-9A-Za-z_]+)', 'low'), ('num', 'id=[0-9]+', '')])})")
    raw = f"CASE page_id % 5 WHEN 0 THEN '\"' || url || '\"' WHEN 1 THEN chr(9) || ' ''' || url || ''' ' || {NL} WHEN 2 THEN '`' || url || '\"' WHEN 3 THEN html ELSE '\"' END"
    put("js_clean_value", f"SELECT page_id, {clean('raw')} AS value FROM (SELECT page_id, {raw} AS raw FROM pages)")
    put("js_length_gate", f"SELECT {_IT} FROM ({items(js, None, 8)})")
    put("js_exclude", f"SELECT {_IT} FROM ({items(js)}) WHERE NOT regexp_matches(value, '(?i)example[.]com') AND lower(value) <> 'widget'")
    every = items(js)
    put("js_dedup", f"SELECT {_IT}, pattern_ord, match_ord FROM ({every}) QUALIFY category = 'comments' OR row_number() OVER (PARTITION BY category, value ORDER BY path, category_ord, line_number, pattern_ord, match_ord) = 1")
    put("js_distinct", f"SELECT DISTINCT category, value FROM ({every})")
    put("js_context", f"SELECT {_IT}, context FROM ({items(js)})")
    put("js_category_filter", f"SELECT {_IT} FROM ({items(js, ['env_vars', 'graphql', 'cookies'])})")
    put("js_confidence_filter", f"SELECT {_IT} FROM ({every}) WHERE {_CONF} <= 1")
    put("js_sorted", f"SELECT {_IT} FROM ({every}) ORDER BY category_ord, {_CONF}, path, line_number, pattern_ord, match_ord")
    names = ", ".join(f"({lit(c)})" for c in CATEGORIES)
    put("js_stats_per_file", f"WITH i AS MATERIALIZED (SELECT * FROM ({every})) SELECT p.path, c.category, count(i.value) AS n FROM (SELECT DISTINCT path FROM i) p CROSS JOIN (VALUES {names}) AS c(category) LEFT JOIN i ON i.path = p.path AND i.category = c.category GROUP BY 1, 2")
    put("js_stats", f"SELECT category, count(*) AS n FROM ({every}) GROUP BY 1")
    put("js_totals", f"SELECT (SELECT count(*) FROM {js}) AS files_analyzed, (SELECT count(*) FROM ({every})) AS total_findings")
    put("js_file_sizes", f"SELECT path, length(content) AS file_size FROM {DOCS} WHERE {strip('content')} <> ''")
    # findings
    put("vuln_findings", f"SELECT {_FI} FROM ({fi})")
    for g in GROUPS:
        put(f"vuln_{g}", f"SELECT {_FI} FROM ({findings(js, [g])})")
    texts = f"(SELECT * FROM {tagged(_INLINE)} UNION ALL SELECT * FROM {DOCS})"
    put("vuln_documents", f"SELECT {_FI.replace('file', 'string_split(file, chr(1))[1] AS file')} FROM ({findings(texts)})")
    put("vuln_locations", f'SELECT file, rule_id, line, "column", "offset" FROM ({findings(js)})')
    put("vuln_taint_gate", f'SELECT file, rule_id, line, "column" FROM ({findings(js)})')
    put("vuln_no_info", f"SELECT {_FI} FROM ({findings(js, include_info=False)})")
    put("vuln_ranked", f'SELECT {_FI}, CAST({_RANK} AS INTEGER) AS rank FROM ({fi}) ORDER BY rank DESC, file, line, rule_ord, "offset"')
    put("vuln_severity_counts", f"SELECT severity, count(*) AS n FROM ({fi}) GROUP BY 1")
    put("vuln_gate", f"SELECT CAST(coalesce(max(CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 1 ELSE 0 END), 0) AS INTEGER) AS exit_code FROM ({fi})")
    globs = " AND ".join(f"NOT regexp_matches(string_split(path, '/')[-1], {lit(glob_to_regex(g))})" for g in ["*.min.js", "app1?.js"])
    put("vuln_glob_exclude", f"SELECT {_FI} FROM ({findings(f'(SELECT * FROM {js} WHERE {globs})')})")
    put("vuln_enriched", f'SELECT rule_id, file, line, "column", title, cwe, remediation, description, tags FROM ({fi}) JOIN {_RULES} ON rid = rule_id')
    put("vuln_tag_counts", f"SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(tags, ',')) AS tag FROM ({fi}) JOIN {_RULES} ON rid = rule_id) GROUP BY 1")
    tok = lit(token(BY_KEY["javascript"]).pattern)
    blanked = (
        f"(SELECT path, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(regexp_replace(hits[i], '[^' || {NL} || ']', ' ', 'g'), '')), '') AS content "
        f"FROM (SELECT path, string_split_regex(content, {tok}) AS gaps, regexp_extract_all(content, {tok}, 0) AS hits FROM {js}))"
    )
    put("vuln_with_stmt", f"SELECT {lit(WITH_RULE.rule_id)} AS rule_id, path AS file, line, col AS \"column\" FROM ({matches(blanked, WITH_RULE.rx)})")
    # comments
    put("comment_language", f"SELECT path, {_TITLES} AS language FROM (SELECT path, {_LANG} AS lang FROM {src})")
    put("comments_html", f"SELECT {_CO} FROM ({comments(PAGES_AS_CORPUS, ['web_markup'])})")
    put("comments_js", f"SELECT {_CO} FROM ({comments(js, ['javascript'])})")
    for c in ("css", "python", "sql"):
        put(f"comments_{c}", f"SELECT {_CO} FROM ({comments(src, [c])})")
    put("comments_all", f"SELECT {_CO} FROM ({co})")
    put("comment_spans", f'SELECT path, line_start, line_end, type, "offset" FROM ({co})')
    put("comment_min_length", f"SELECT {_CO} FROM ({co}) WHERE length(text) >= 12")
    dirs = ", ".join(lit(d) for d in EXCLUDED_DIRS)
    put("comment_path_filter", f"SELECT path FROM {src} WHERE NOT list_has_any(string_split(path, '/')[:-2], [{dirs}]) AND ({_EXT} IN ('.go', '.py', '.html') OR {_NAME} = 'dockerfile')")
    put("comment_stats", f"SELECT (SELECT count(*) FROM {src}) AS files_scanned, count(DISTINCT path) AS files_with_comments, count(*) AS total_comments FROM ({co})")
    put("comment_by_language", f"SELECT language, count(DISTINCT path) AS files, count(*) AS comments FROM ({co}) GROUP BY 1")
    put("comment_per_file", f"""SELECT path, language, CAST(count(*) AS INTEGER) AS comment_count, string_agg(line_start || ':' || text, '|' ORDER BY "offset") AS comments FROM ({co}) GROUP BY 1, 2""")
    # URLs
    put("url_union_distinct", f"SELECT url FROM {urls} UNION SELECT url || CASE WHEN page_id % 2 = 0 THEN '#feed' ELSE '' END FROM pages")
    put("url_domain_filter", rf"SELECT url FROM {urls} WHERE regexp_matches(url, '(?i)site3\.example\.com\b')")
    host = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"
    put("domain_valid", f"SELECT domain, regexp_matches(domain, {lit(DOMAIN_NAME)}) AS valid FROM (SELECT DISTINCT CASE length(url) % 3 WHEN 0 THEN '-' || {host} WHEN 1 THEN {host} || '..' ELSE {host} END AS domain FROM {urls})")
    site = f"coalesce(nullif({_SITE('url')}, ''), url)"
    inside = "(" + " OR ".join(f"{site} ILIKE {lit(p.replace('*', '%'))}" for p in scope_patterns(SCOPE)) + ")"
    put("url_in_scope", f"SELECT url FROM {urls} WHERE {inside}")
    put("url_scope_dropped", f"SELECT count(*) AS out_of_scope_dropped FROM {urls} WHERE NOT {inside}")
    base = "string_split(string_split(url, '?')[1], '#')[1]"
    paths, important = f"SELECT DISTINCT {base} AS path FROM {urls}", lit("(?i)" + IMPORTANT_PATH)
    put("url_clean_paths", paths)
    put("url_important_paths", f"SELECT path FROM ({paths}) WHERE regexp_matches(path, {important})")
    put("url_categories", cats)
    params = f"SELECT DISTINCT unnest(regexp_extract_all(string_split(url, '?')[2], {lit(QUERY_NAME)}, 1)) AS parameter FROM {urls}"
    put("url_param_names", params)
    kept = f"(SELECT url FROM {urls} WHERE {inside})"
    at = lambda q: q.replace(urls, kept)
    put("url_summary", f"SELECT (SELECT count(*) FROM {kept}) AS total_urls, (SELECT count(*) FROM ({at(paths)})) AS clean_paths, "
        f"(SELECT count(*) FROM ({at(paths)}) WHERE regexp_matches(path, {important})) AS important_paths, (SELECT count(*) FROM ({at(params)})) AS unique_parameters, "
        f"(SELECT count(*) FROM {urls} WHERE NOT {inside}) AS out_of_scope_dropped")
    labels = {
        "total_urls": "[+] Total Distinct URLs Discovered : ", "clean_paths": "[+] Clean Directory Paths Found     : ",
        "important_paths": "[+] Critical/Important Paths Found  : ", "unique_parameters": "[+] Unique URL Parameter Keys Found : ",
        "out_of_scope_dropped": "[+] Out-of-scope URLs Dropped       : ",
    }
    bar = "repeat('=', 53)"
    counted = f" || {NL} || ".join(f"{lit(t)} || {c}" for c, t in labels.items())
    report("report_urls", block(0, "''", f"{bar} || {NL} || '           URL INVENTORY OF EXAMPLE.COM' || {NL} || {bar} || {NL} || {NL} || {counted} || {NL} || {NL} || {bar}", "FROM s"), f"WITH s AS ({ORACLE['url_summary']})")
    put("sink_inventory", f"SELECT 'clean_paths' AS output, path AS value FROM ({paths}) UNION ALL SELECT 'important_paths', path FROM ({paths}) WHERE regexp_matches(path, {important}) "
        f"UNION ALL SELECT 'parameters', parameter FROM ({params}) UNION ALL SELECT DISTINCT 'files_' || category, url FROM ({cats})")
    put("url_param_substitute", f"SELECT DISTINCT regexp_replace(url, '=[^&#]*', '=aa2a', 'g') AS url FROM {urls} WHERE contains(url, '?')")
    put("url_js_only", f"SELECT url FROM {urls} WHERE url ILIKE '%.js%'")
    # responses, hosts, files
    stem = "string_split(url, '?')[1]"
    put("response_diff", f"WITH r AS MATERIALIZED (SELECT {stem} AS base_url, url, status || '_' || length AS v FROM {resp}) SELECT DISTINCT base_url, url FROM r WHERE base_url IN (SELECT base_url FROM r GROUP BY 1 HAVING count(DISTINCT v) > 1)")
    report("report_differences", " UNION ALL ".join([
        block(1, "base_url", "chr(128293) || ' ' || base_url", "FROM (SELECT DISTINCT base_url FROM d)", "0"),
        block(1, "base_url", "url", "FROM d", "1"), block(1, "base_url", "''", "FROM (SELECT DISTINCT base_url FROM d)", "2"),
    ]), f"WITH d AS MATERIALIZED (SELECT * FROM ({ORACLE['response_diff']}))")
    put("url_online", f"SELECT DISTINCT url FROM {resp} WHERE status = '200' AND contains(url, 'aa2a')")
    whole, name = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)", "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
    hosts = f"(SELECT DISTINCT CASE length(url) % 4 WHEN 0 THEN {whole} || '//' WHEN 1 THEN {name} WHEN 2 THEN '' ELSE {name} || '/' END AS host FROM {urls})"
    target = "CASE WHEN host <> '' THEN rtrim(CASE WHEN contains(host, '://') THEN host ELSE 'http://' || host END, '/') END"
    put("target_normalize", f"SELECT host, {target} AS target FROM {hosts}")
    put("host_port_targets", f"SELECT {target} || ':' || p AS url FROM {hosts} CROSS JOIN (VALUES ('80'), ('8443'), ('3000')) AS t(p) WHERE host <> ''")
    results = f"(SELECT DISTINCT url, CASE WHEN length(url) % 2 = 0 THEN CAST(status AS INTEGER) END AS status_code FROM {resp})"
    put("status_ok_flag", f"SELECT *, coalesce(status_code IN (200, 302, 403), false) AS ok FROM {results}")
    put("status_ok_sorted", f"SELECT status_code || ' : ' || url AS line FROM {results} WHERE status_code IN ({', '.join(map(str, DEFAULT_OK))})")
    codes = ", ".join(f"'{c}'" for c in BUCKETS)
    put("status_buckets", f"SELECT status AS bucket, count(*) AS n FROM {resp} WHERE status IN ({codes}) GROUP BY 1")
    put("status_buckets_substring", f"SELECT bucket, count(*) AS n FROM {resp} JOIN (SELECT unnest([{codes}, '512']) AS bucket) ON contains(url || ' ' || status || ' ' || length, bucket) GROUP BY 1")
    put("strip_ansi", "SELECT page_id, url || ' ' || html AS text FROM pages")
    put("safe_name", """SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(CASE WHEN page_id % 9 = 0 THEN 'https://??' ELSE url END, '^https?://', ''), '[\\\\/:*?"<>|]+', '_', 'g'), '_'), ''), 'target') AS name FROM pages""")
    escaped = "html"
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        escaped = f"replace({escaped}, {lit(a)}, {lit(b)})"
    put("html_escape", f"SELECT page_id, {escaped} AS escaped FROM pages")
    body = f"CASE WHEN length(content) % 40 < 12 THEN repeat('[]! +()' || {NL}, length(content) % 7) ELSE content END"
    dense = f"regexp_replace({body}, '[[:space:]]', '', 'g')"
    only = f"regexp_matches({dense}, '^[][()!+]*$')"
    put("jsfuck_gate", f"SELECT path, (length({dense}) > 20 AND {only}) AS obfuscated, {only} AS symbols_only FROM {js}")
    put("js_file_select", f"SELECT path FROM (SELECT url || CASE WHEN length(url) % 2 = 0 THEN '.map' ELSE '' END AS path FROM {urls}) WHERE ends_with(path, '.js')")
    # the whole chain
    made = TABLES["js_corpus"][0].replace("SELECT ", "SELECT page_id, ", 1)

    def audit(corpus: str) -> str:
        return (
            f"SELECT source_file AS source, 'endpoint' AS kind, endpoint_type AS category, NULL::VARCHAR AS severity, url AS value, line_number AS line FROM ({endpoints(corpus)}) "
            f"UNION ALL SELECT path, 'item', category, confidence, value, line_number FROM ({items(corpus)}) "
            f"UNION ALL SELECT file, 'finding', rule_id, severity, snippet, line FROM ({findings(corpus)}) "
            f"UNION ALL SELECT path, 'comment', type, NULL, text, line_start FROM ({comments(corpus)})"
        )

    whole_audit = audit(BOTH)
    put("audit_all", whole_audit)
    put("audit_rollup", f"SELECT source, kind, category, CAST(count(*) AS BIGINT) AS n, CAST(grouping(source, kind, category) AS INTEGER) AS level FROM ({whole_audit}) GROUP BY ROLLUP (source, kind, category)")
    put("audit_new_scripts", f"SELECT DISTINCT url FROM ({ep}) WHERE url ILIKE '%.js%' AND url NOT IN (SELECT url FROM {urls})")
    chain = f"(SELECT path, content FROM ({made}) WHERE page_id % 3 < 2 AND page_id % 5 <> 0)"
    put("audit_chain", f"{audit(chain)} UNION ALL SELECT NULL, 'new_script', NULL, NULL, url, NULL FROM (SELECT DISTINCT url FROM ({endpoints(chain)}) "
        f"WHERE url ILIKE '%.js%' AND url NOT IN (SELECT path FROM ({made}) WHERE page_id % 5 <> 0))")
    put("audit_resume", f"SELECT kind, count(*) AS n FROM ({audit(js)}) GROUP BY 1")
    # streams
    put("stream_endpoints", f"SELECT {ep_cols} FROM ({endpoints('(SELECT url AS path, html AS content FROM pages)')})")
    put("stream_first_seen", f"WITH i AS MATERIALIZED ({items(js)}) SELECT DISTINCT category, value FROM i WHERE category <> 'comments' "
        "UNION ALL SELECT category, value FROM i WHERE category = 'comments'")
    timed = f"(SELECT (page_id % 24 * 600 + 1699999200) || chr(1) || path AS path, content FROM ({made}))"
    times = f"SELECT CAST(string_split(file, chr(1))[1] AS BIGINT) AS t, severity FROM ({findings(timed)})"
    put("stream_counts", f"WITH f AS MATERIALIZED ({times}) SELECT strftime(make_timestamp(t // 3600 * 3600000000), '%Y-%m-%d %H:%M:%S') AS window_start, "
        "severity, count(*) AS n FROM f WHERE (t // 3600 + 1) * 3600 <= (SELECT max(t) FROM f) - 3600 GROUP BY 1, 2")


build()
