"""Named queries: each operator applied to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesieve.catalog.endpoint_types import ENDPOINT_TYPES
from pagesieve.catalog.js_categories import CATEGORIES, WHOLE_TEXT
from pagesieve.catalog.vuln_rules import GROUPS
from pagesieve.functions import storage
from pagesieve.functions import text as T
from pagesieve.functions.url import with_join, with_normalized
from pagesieve.operators import audit as A
from pagesieve.operators import comments as C
from pagesieve.operators import endpoints as E
from pagesieve.operators import findings as V
from pagesieve.operators import html as H
from pagesieve.operators import items as I
from pagesieve.operators import links as L
from pagesieve.operators import responses as R
from pagesieve.operators import scripts as S
from pagesieve.operators import urls as U
from pagesieve.plans.derived import SCOPE, TABLES, table
from pagesieve.sources import corpus as SRC
from pagesieve.sources import reports as REPORT
from pagesieve.sources import sinks as SINK
from pagesieve.streaming import streams as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CUSTOM = [("track", r"ref=(\w+)", "low"), ("num", r"id=\d+", "")]
EXCLUDE = ["example\\.com", "^widget$"]
DEPTH = 3


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def on(name: str, tab: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Register ``build`` over one table."""
    QUERIES[name] = lambda spark, d, b=build, t=tab: b(table(spark, d, t))


def documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return SRC.text_corpus(docs, F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.col("text"))


def scripts_and_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "js_corpus").unionByName(
        SRC.pages_corpus(table(spark, d, "pages")).withColumn("path", F.concat("path", F.lit(".html")))
    )


# --- sources and sinks -------------------------------------------------------------------

on("pages_corpus", "pages", SRC.pages_corpus)


@query("scan_corpus")
def _(spark, d):
    """Write page lines as text files in folders, scan them back without the skipped folder."""
    out = storage.scratch(spark, "scan")
    folder = F.when(F.col("page_id") % 5 == 0, "node_modules").otherwise("src")
    rows = table(spark, d, "pages").select(folder.alias("folder"), F.concat_ws(" ", "page_id", "url").alias("value"))
    rows.filter("folder = 'src'").select("value").write.text(f"{out}/src")
    rows.filter("folder <> 'src'").select("value").write.text(f"{out}/node_modules")
    files = SRC.scan_files(spark, out, extensions=[".txt"], kind="text")
    where = F.regexp_extract("path", "/(src|node_modules)/[^/]*$", 1)
    lines = files.select(where.alias("folder"), "kind", F.explode_outer(F.split("content", "\n")).alias("line"))
    return lines.filter("line <> ''")


@query("decode_text")
def _(spark, d):
    title = F.regexp_extract("html", r"<title>([^<]*)", 1)
    ascii_part = F.regexp_replace(title, "[^ -~]", "")
    raw = (
        F.when(F.col("page_id") % 3 == 0, F.encode(title, "UTF-8"))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit(bytearray(b"\xe9")), F.encode(ascii_part, "UTF-8")))
        .otherwise(F.concat(F.encode(ascii_part, "UTF-8"), F.lit(bytearray(b"\x00"))))
    )
    return SRC.decode_text(table(spark, d, "pages").select("page_id", raw.alias("raw")))


@query("list_source")
def _(spark, d):
    line = F.concat(
        F.when(F.col("page_id") % 4 == 0, " # ").when(F.col("page_id") % 4 == 1, "\t ").otherwise(""),
        F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("url")), F.lit("  "),
    )
    return SRC.list_source(table(spark, d, "pages").select(line.alias("value")))


@query("sourcemap_explode")
def _(spark, d):
    content = F.to_json(F.struct(
        F.array(F.lit("a.js"), F.lit("b.js"), F.lit("c.js")).alias("sources"),
        F.array("url", F.when(F.col("page_id") % 2 == 0, F.lit("")).otherwise(F.lit("x=1;"))).alias("sourcesContent"),
    ))
    bad = F.when(F.col("page_id") % 7 == 0, F.lit("{bad")).otherwise(content)
    maps = table(spark, d, "pages").select(F.concat("url", F.lit(".js.map")).alias("path"), bad.alias("content"))
    return SRC.explode_source_maps(maps)


@query("response_log_parse")
def _(spark, d):
    line = F.concat(
        F.lit("  "), "url", F.lit(" "), "status",
        F.when(F.col("length") == "512", "").otherwise(F.concat(F.lit("\t"), "length", F.lit(" h1"))),
    )
    return SRC.parse_response_log(table(spark, d, "responses").select(line.alias("value")))


@query("sink_json_roundtrip")
def _(spark, d):
    out = storage.scratch(spark, "json")
    rows = V.findings(table(spark, d, "js_corpus")).select("rule_id", "file", "line", "column", "snippet")
    SINK.write_json(rows, out, total="total_findings")
    return spark.read.schema(rows.schema).json(f"{out}/rows")


@query("sink_csv_roundtrip")
def _(spark, d):
    out = storage.scratch(spark, "csv")
    rows = I.js_items(table(spark, d, "js_corpus"))
    SINK.write_csv(rows, out)
    back = spark.read.schema("category string, value string, confidence string, line_number int, path string")
    return back.option("header", True).option("escape", '"').option("multiLine", True).csv(out)


on("report_lines", "js_corpus", lambda c: SINK.finding_lines(V.findings(c)))
on("endpoint_lines", "js_corpus", lambda c: SINK.endpoint_lines(E.endpoints(c, context=False)))
on("item_lines", "js_corpus", lambda c: SINK.item_lines(I.js_items(c)))
on("comment_lines", "source_corpus", lambda c: SINK.comment_lines(C.comments(c)))
on("severity_line", "js_corpus", lambda c: SINK.severity_line(V.severity_counts(V.findings(c))))


@query("comment_lang_slug")
def _(spark, d):
    """Written in one folder per language and read back with the folder as a column."""
    out = storage.scratch(spark, "lang")
    found = C.comments(table(spark, d, "source_corpus")).select("path", "language", "text", "line_start")
    SINK.write_by_language(found, out)
    back = spark.read.schema("path string, language string, text string, line_start int, lang_slug string").json(out)
    return back.groupBy("language", "lang_slug").agg(F.count("*").alias("n"))


@query("sink_url_categories")
def _(spark, d):
    out = storage.scratch(spark, "cats")
    SINK.write_by_category(U.categories(table(spark, d, "urls")), out)
    back = spark.read.schema("value string, category string").text(out)
    return back.select("category", F.col("value").alias("url"))


def _read_back(spark: SparkSession, path: str) -> DataFrame:
    """(nr, line) of a report's part files in the order of their names."""
    parts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\n").alias("lines"))
    sizes = parts.select("file", (F.size("lines") - 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    lines = parts.select("file", F.posexplode(F.slice("lines", 1, F.size("lines") - 1)).alias("pos", "line"))
    starts = sizes.select("file", F.coalesce(before, F.lit(0)).alias("begin"))
    return lines.join(starts, "file").select((F.col("begin") + F.col("pos")).cast("long").alias("nr"), "line")


def report(name: str, tab: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Register a report: written in parallel, then read back line by line."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = storage.scratch(spark, name)
        REPORT.write_lines(build(table(spark, d, tab)), out)
        return _read_back(spark, out)

    QUERIES[name] = run


report("report_findings", "js_corpus", lambda c: REPORT.finding_report(V.findings(c)))
report("report_items", "js_corpus", lambda c: REPORT.item_report(I.js_items(c), c))
report("report_comments", "source_corpus", lambda c: REPORT.comment_report(C.comments(c), c, "sources"))
report("report_urls", "urls", lambda u: REPORT.url_report(u.unionByName(u), "example.com", SCOPE))
report("report_differences", "responses", REPORT.difference_report)

_DOCUMENT = ["rule_id", "file", "line", "column", "snippet"]
_FOUND = "array<struct<rule_id:string,file:string,line:int,`column`:int,snippet:string>>"


def _document(spark: SparkSession, d: str, name: str, **kw) -> DataFrame:
    """Findings written as one JSON document, and its text."""
    out = storage.scratch(spark, name)
    found = V.findings(table(spark, d, "js_corpus"))
    order = [F.desc(V.rank(F.col("severity"))), "file", "line", "rule_ord", "offset"]
    REPORT.write_document(found, out, order=order, columns=_DOCUMENT, **kw)
    lines = _read_back(spark, out)
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nr", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query("sink_json_document")
def _(spark, d):
    """The metadata and every element, each with its place, of a document that is parsed as a whole."""
    facts = {"tool": F.lit("pagesieve"), "timestamp": F.current_timestamp(), "files_analyzed": F.count_distinct("file"), "total_findings": F.count("*")}
    text = _document(spark, d, "document", metadata=facts)
    schema = f"metadata struct<tool:string,timestamp:timestamp,files_analyzed:long,total_findings:long>, results {_FOUND}"
    parsed = text.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("doc"))
    told = [F.col(f"doc.metadata.{c}").alias(c) for c in ("tool", "files_analyzed", "total_findings")]
    dated = F.col("doc.metadata.timestamp").isNotNull().alias("dated")
    return parsed.select(*told, dated, F.posexplode("doc.results").alias("nr", "r")).select("tool", "files_analyzed", "total_findings", "dated", "nr", "r.*")


@query("sink_json_array")
def _(spark, d):
    """The bare sorted array."""
    text = _document(spark, d, "array")
    return text.select(F.posexplode(F.from_json("text", _FOUND, {"mode": "FAILFAST"})).alias("nr", "r")).select("nr", "r.*")


@query("sink_inventory")
def _(spark, d):
    """Categories, clean and important paths and parameter names, written at once."""
    out = storage.scratch(spark, "inventory")
    REPORT.write_inventory(table(spark, d, "urls"), out, rows_per_file=1000)
    return spark.read.schema("value string, output string").text(out).select("output", "value")


# --- HTML --------------------------------------------------------------------------------

on("html_script_src", "rich_pages", H.script_sources)
on("html_inline_scripts", "rich_pages", lambda p: H.inline_scripts(p).select("page_url", "content"))
on("html_inline_endpoints", "rich_pages", lambda p: E.endpoints(H.inline_scripts(p), path="page_url").select(
    "source_file", "url", "endpoint_type", "line_number"))
on("html_event_attrs", "rich_pages", lambda p: H.event_handlers(p).select("page_url", "tag", "attribute", "content"))
on("html_event_endpoints", "rich_pages", lambda p: E.endpoints(H.event_handlers(p), path="page_url").select(
    "source_file", "url", "endpoint_type"))
on("html_links", "rich_pages", lambda p: H.links(p).select("page_url", "href", "link_url"))
on("html_internal_links", "rich_pages", lambda p: H.internal(H.links(p)).select("page_url", "link_url"))
on("link_reach", "link_edges", lambda e: L.reach(e, e.filter("src = 0").select(F.col("src").alias("node")), DEPTH))


@query("reached_scripts")
def _(spark, d):
    pages = table(spark, d, "rich_pages")
    edges = L.page_edges(H.internal(H.links(pages)))
    seeds = pages.filter("page_id % 10 = 0").select(F.col("url").alias("node"))
    return L.reached_scripts(L.reach(edges, seeds, 2), H.script_sources(pages))


# --- endpoints ---------------------------------------------------------------------------

_EP = ["source_file", "url", "line_number", "endpoint_type"]
for _type, _ in ENDPOINT_TYPES:
    on(f"ep_{_type}", "js_corpus", lambda c, t=_type: E.endpoints(c, types=[t]).select(*_EP))


@query("endpoints_all")
def _(spark, d):
    return E.endpoints(scripts_and_pages(spark, d)).select(*E.COLUMNS)


@query("ep_valid_filter")
def _(spark, d):
    """Verdict on the raw quoted strings of the scripts."""
    c = table(spark, d, "js_corpus")
    raw = c.select(F.explode_outer(F.regexp_extract_all("content", F.lit("[\"'`]([^\"'`\n]*)[\"'`]"), F.lit(1))).alias("value"))
    return raw.filter("value is not null").distinct().select(
        "value", E.is_endpoint(F.col("value")).alias("ok"), E.is_endpoint(F.col("value"), True).alias("ok_no_assets")
    )


def _references(pages: DataFrame) -> DataFrame:
    p = F.col("page_id")
    ps = p.cast("string")
    forms = [
        F.concat(F.lit("/root/"), ps, F.lit("?a=1#f")), F.concat(F.lit("../up/"), ps, F.lit(".js")),
        F.concat(F.lit("./here/../"), ps, F.lit("/")), F.concat(F.lit("//cdn"), ps, F.lit(".example.com/x?y=/z")),
        F.concat(F.lit("a//b/./c"), ps, F.lit(".,;")), F.lit("?only=query"), F.lit("#frag"), F.lit(" /trim/.. "),
        F.lit("https://abs.example.com/k#z"), F.lit("wss://abs.example.com"), F.lit(""),
    ]
    base = F.when(p % 3 == 0, F.concat(F.lit("src/lib/f"), ps, F.lit(".js"))).when(p % 3 == 1, F.lit("app.js")).otherwise(
        F.concat(F.lit("https://h"), ps, F.lit(".example.com/d1/d2/f.js?v=1")))
    return pages.select("page_id", base.alias("base"), F.posexplode_outer(F.array(*forms)).alias("form", "ref"))


on("url_normalize", "pages", lambda p: with_normalized(_references(p), "ref", "base", "resolved").select(
    "page_id", "form", "base", "resolved"))
on("url_join", "pages", lambda p: with_join(_references(p), "ref", "base", "resolved").select(
    "page_id", "form", "base", "resolved"))
on("ep_line_numbers", "js_corpus", lambda c: E.endpoints(c, context=False, method=False).select(
    "source_file", "pattern_ord", "offset", "line_number"))
on("ep_context", "js_corpus", lambda c: E.endpoints(c, method=False).select("source_file", "pattern_ord", "offset", "context"))
on("ep_method", "js_corpus", lambda c: E.endpoints(c, context=False).select("source_file", "pattern_ord", "offset", "method"))
on("ep_dedup", "js_corpus", lambda c: E.dedup_endpoints(E.endpoints(c)))
on("ep_filter", "js_corpus", lambda c: E.filter_endpoints(E.dedup_endpoints(E.endpoints(c)), "/(API|rest)/").select(*_EP))
on("ep_type_counts", "js_corpus", lambda c: E.count_by_type(E.endpoints(c, context=False, method=False)))
on("ep_method_counts", "js_corpus", lambda c: E.count_by_method(E.endpoints(c, context=False)))
on("ep_file_counts", "js_corpus", lambda c: E.count_by_file(E.endpoints(c, context=False, method=False)))

# --- items -------------------------------------------------------------------------------

_IT = ["path", "category", "value", "line_number", "confidence"]


def items(c: DataFrame, **kw) -> DataFrame:
    return I.js_items(c, **kw)


for _cat in CATEGORIES:
    if _cat in ("secrets", "emails", "ip_addresses"):
        QUERIES[f"js_{_cat}"] = lambda spark, d, c=_cat: items(
            documents(spark, d).unionByName(table(spark, d, "js_corpus")), categories=[c]).select(*_IT)
    else:
        on(f"js_{_cat}", "js_corpus", lambda c, k=_cat: items(c, categories=[k]).select(*_IT))


@query("js_items_all")
def _(spark, d):
    c = documents(spark, d).unionByName(table(spark, d, "js_corpus"))
    return items(c).select(*_IT, "pattern_ord", "match_ord")


on("js_custom", "js_corpus", lambda c: items(c, categories=[I.CUSTOM], custom=CUSTOM).select(*_IT))


@query("js_clean_value")
def _(spark, d):
    """Cleaning of quoted, padded and long values made from pages."""
    pages = table(spark, d, "pages")
    p = F.col("page_id")
    v = (
        F.when(p % 5 == 0, F.concat(F.lit('"'), "url", F.lit('"')))
        .when(p % 5 == 1, F.concat(F.lit("\t '"), "url", F.lit("' \n")))
        .when(p % 5 == 2, F.concat(F.lit("`"), "url", F.lit('"')))
        .when(p % 5 == 3, F.col("html")).otherwise(F.lit('"'))
    )
    return pages.select("page_id", T.clean_value(v).alias("value"))


on("js_length_gate", "js_corpus", lambda c: items(c, min_length=8).select(*_IT))
on("js_exclude", "js_corpus", lambda c: items(c, exclude=EXCLUDE).select(*_IT))
on("js_dedup", "js_corpus", lambda c: I.first_seen(items(c)).select(*_IT, "pattern_ord", "match_ord"))
on("js_distinct", "js_corpus", lambda c: I.distinct_values(items(c)))
on("js_context", "js_corpus", lambda c: items(c, context=True).select(*_IT, "context"))
on("js_category_filter", "js_corpus", lambda c: items(c, categories=["env_vars", "graphql", "cookies"]).select(*_IT))
on("js_confidence_filter", "js_corpus", lambda c: I.at_least(items(c), "high").select(*_IT))
on("js_sorted", "js_corpus", lambda c: I.sort_items(items(c)).select(*_IT))
on("js_stats_per_file", "js_corpus", lambda c: I.stats_per_file(items(c)))
on("js_stats", "js_corpus", lambda c: I.stats(items(c)))
on("js_totals", "js_corpus", lambda c: I.totals(items(c), c))
QUERIES["js_file_sizes"] = lambda spark, d: I.file_sizes(documents(spark, d))

# --- findings ----------------------------------------------------------------------------

_FI = ["rule_id", "severity", "file", "line", "column", "snippet"]
on("vuln_findings", "js_corpus", lambda c: V.findings(c).select(*_FI))
for _group in GROUPS:
    on(f"vuln_{_group}", "js_corpus", lambda c, g=_group: V.findings(c, groups=[g]).select(*_FI))


@query("vuln_documents")
def _(spark, d):
    """All rules over the documents and the inline scripts of the pages."""
    scripts = H.inline_scripts(table(spark, d, "rich_pages"))
    corpus = SRC.text_corpus(scripts, F.col("page_url"), F.col("content"), "js").unionByName(documents(spark, d))
    return V.findings(corpus).select(*_FI)


on("vuln_locations", "js_corpus", lambda c: V.findings(c).select(
    "file", "rule_id", "line", "column", "offset"))
on("vuln_taint_gate", "js_corpus", lambda c: V.findings(c).select("file", "rule_id", "line", "column"))
on("vuln_no_info", "js_corpus", lambda c: V.findings(c, include_info=False).select(*_FI))
on("vuln_ranked", "js_corpus", lambda c: V.sort_findings(V.findings(c)).select(
    *_FI, V.rank(F.col("severity")).alias("rank")))
on("vuln_severity_counts", "js_corpus", lambda c: V.severity_counts(V.findings(c)))
on("vuln_gate", "js_corpus", lambda c: V.gate(V.findings(c)))
on("vuln_glob_exclude", "js_corpus", lambda c: V.findings(V.exclude_globs(c, ["*.min.js", "app1?.js"])).select(*_FI))
on("vuln_enriched", "js_corpus", lambda c: V.enrich(V.findings(c)).select(
    "rule_id", "file", "line", "column", "title", "cwe", "remediation", "description",
    F.array_join("tags", ",").alias("tags")))
on("vuln_tag_counts", "js_corpus", lambda c: V.tag_counts(V.findings(c)))
on("vuln_with_stmt", "js_corpus", lambda c: V.with_findings(c).select("rule_id", "file", "line", "column"))

# --- comments ----------------------------------------------------------------------------

_CO = ["path", "language", "line_start", "line_end", "text", "type"]
on("comment_language", "source_corpus", lambda c: C.detect_language(c).select("path", "language"))
QUERIES["comments_html"] = lambda spark, d: C.comments(
    SRC.pages_corpus(table(spark, d, "pages")).withColumn("path", F.concat("path", F.lit(".html")))).select(*_CO)
on("comments_js", "js_corpus", lambda c: C.comments(c).select(*_CO))
for _name, _key in [("css", "css"), ("python", "python"), ("sql", "sql")]:
    on(f"comments_{_name}", "source_corpus", lambda c, k=_key: C.comments(c, languages=[k]).select(*_CO))
on("comments_all", "source_corpus", lambda c: C.comments(c).select(*_CO))
on("comment_spans", "source_corpus", lambda c: C.comments(c).select("path", "line_start", "line_end", "type", "offset"))
on("comment_min_length", "source_corpus", lambda c: C.comments(c, min_length=12).select(*_CO))
on("comment_path_filter", "source_corpus", lambda c: C.select_paths(
    c, extensions=[".go", ".py", "dockerfile", ".html"]).select("path"))
on("comment_stats", "source_corpus", lambda c: C.stats(C.comments(c), c))
on("comment_by_language", "source_corpus", lambda c: C.by_language(C.comments(c)))
on("comment_per_file", "source_corpus", lambda c: C.per_file(C.comments(c)).select(
    "path", "language", "comment_count",
    F.array_join(F.transform("comments", lambda x: F.concat_ws(":", x["line_start"].cast("string"), x["text"])), "|").alias("comments")))

# --- URLs --------------------------------------------------------------------------------


@query("url_union_distinct")
def _(spark, d):
    pages = table(spark, d, "pages")
    other = pages.select(F.concat(F.lit(" "), "url", F.when(F.col("page_id") % 2 == 0, "#feed").otherwise(""), F.lit("\t")).alias("url"))
    return U.inventory(table(spark, d, "urls"), other, other, pages.select(F.lit("  ").alias("url")))


on("url_domain_filter", "urls", lambda u: U.on_domain(u, "site3.example.com"))


def _host_names(u: DataFrame) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1)
    odd = F.when(F.length("url") % 3 == 0, F.concat(F.lit("-"), host)).when(
        F.length("url") % 3 == 1, F.concat(host, F.lit(".."))).otherwise(host)
    return u.select(odd.alias("domain")).distinct()


on("domain_valid", "urls", lambda u: _host_names(u).select("domain", U.is_domain_name(F.col("domain")).alias("valid")))
on("url_in_scope", "urls", lambda u: U.in_scope(u, SCOPE))
on("url_scope_dropped", "urls", lambda u: U.scope_dropped(u.unionByName(u), SCOPE))
on("url_clean_paths", "urls", U.clean_paths)
on("url_important_paths", "urls", U.important_paths)
on("url_categories", "urls", U.categories)
on("url_param_names", "urls", U.parameter_names)
on("url_summary", "urls", lambda u: U.summary(u.unionByName(u), SCOPE))
on("url_param_substitute", "urls", lambda u: U.substitute_parameters(u, "aa2a"))
on("url_js_only", "urls", U.scripts_only)

# --- responses, hosts, files ---------------------------------------------------------------

on("response_diff", "responses", R.differences)


@query("url_online")
def _(spark, d):
    r = table(spark, d, "responses")
    asked = r.filter(F.contains("url", F.lit("aa2a"))).select("url").unionByName(table(spark, d, "pages").select("url"))
    return R.online(asked, r)


def _hosts(u: DataFrame) -> DataFrame:
    site = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    n = F.length("url") % 4
    return u.select(F.when(n == 0, F.concat(site, F.lit("//"))).when(n == 1, host).when(n == 2, F.lit("")).otherwise(
        F.concat(host, F.lit("/"))).alias("host")).distinct()


def _results(r: DataFrame) -> DataFrame:
    code = F.when(F.length("url") % 2 == 0, F.col("status").cast("int"))
    return r.select("url", code.alias("status_code")).distinct()


on("target_normalize", "urls", lambda u: _hosts(u).select("host", R.normalize_target(F.col("host")).alias("target")))
on("host_port_targets", "urls", lambda u: R.host_ports(_hosts(u), ["80", " 8443 ", "", "3000"]))
on("status_ok_flag", "responses", lambda r: R.with_ok(_results(r), "200,302 403"))
on("status_ok_sorted", "responses", lambda r: R.ok_lines(R.with_ok(_results(r))))
on("status_buckets", "responses", lambda r: R.status_buckets(r).groupBy("bucket").agg(F.count("*").alias("n")))
on("status_buckets_substring", "responses", lambda r: R.status_buckets(r, [512], substring_mode=True).groupBy("bucket").agg(
    F.count("*").alias("n")))


def _ansi(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.concat(F.lit("\x1b[1;31m"), "url", F.lit("\x1b[0m \x1b[2K"), "html").alias("text"))


on("strip_ansi", "pages", lambda p: _ansi(p).select("page_id", T.strip_ansi(F.col("text")).alias("text")))
on("safe_name", "pages", lambda p: p.select("page_id", T.safe_name(F.when(
    F.col("page_id") % 9 == 0, F.lit("https://??")).otherwise(F.col("url"))).alias("name")))
on("html_escape", "pages", lambda p: p.select("page_id", T.html_escape(F.col("html")).alias("escaped")))


def _maybe_obfuscated(c: DataFrame) -> DataFrame:
    n = F.length("content") % 40
    symbols = F.expr("repeat('[]! +()\n', length(content) % 7)")
    return c.select("path", F.when(n < 12, symbols).otherwise(F.col("content")).alias("content"))


on("jsfuck_gate", "js_corpus", lambda c: _maybe_obfuscated(c).select(
    "path", S.is_obfuscated(F.col("content")).alias("obfuscated"), S.is_obfuscated(F.col("content"), -1).alias("symbols_only")))
on("js_file_select", "urls", lambda u: S.script_files(u.select(F.concat("url", F.when(
    F.length("url") % 2 == 0, ".map").otherwise("")).alias("path"))))

# --- the whole chain -----------------------------------------------------------------------

QUERIES["audit_all"] = lambda spark, d: A.audit(scripts_and_pages(spark, d))
QUERIES["audit_rollup"] = lambda spark, d: A.rollup(A.audit(scripts_and_pages(spark, d)))


@query("audit_new_scripts")
def _(spark, d):
    """Script URLs met in the corpus that the URL inventory lacks."""
    return A.new_scripts(A.audit(table(spark, d, "js_corpus"), ["endpoint"]), table(spark, d, "urls"))


@query("audit_chain")
def _(spark, d):
    """Scripts of the inventory that answered 200, all that is in them, and the scripts that the inventory lacks."""
    table(spark, d, "js_corpus")  # names the tables that the text refers to
    made = spark.sql(TABLES["js_corpus"][0].replace("SELECT ", "SELECT page_id, ", 1))
    known = made.filter("page_id % 5 <> 0").select(F.col("path").alias("url"))
    answers = made.select(F.col("path").alias("url"), F.when(F.col("page_id") % 3 == 2, "404").otherwise("200").alias("status"))
    found = A.audit_crawl(known, answers, made.select("path", "content"))
    none = F.lit(None).cast("string")
    more = A.new_scripts(found, known).select(
        none.alias("source"), F.lit("new_script").alias("kind"), none.alias("category"), none.alias("severity"),
        F.col("url").alias("value"), F.lit(None).cast("int").alias("line"))
    return found.unionByName(more)


@query("audit_resume")
def _(spark, d):
    """A run over scripts of which some are older and some later gone; then one over those of now, which scans only what changed."""
    out = storage.scratch(spark, "audit")
    corpus = table(spark, d, "js_corpus")
    n = F.length("content") % 4
    older = corpus.filter(n != 1).withColumn("content", F.when(n == 2, F.concat("content", F.lit("\neval(old);"))).otherwise(F.col("content")))
    gone = corpus.limit(1).withColumn("path", F.concat("path", F.lit("?gone")))
    A.run(older.unionByName(gone), out)
    return A.run(corpus, out).groupBy("kind").agg(F.count("*").alias("n"))


# --- streams -------------------------------------------------------------------------------

_PAGES = "page_id bigint, url string, html string"


def _run(spark: SparkSession, df: DataFrame, name: str, schema: str) -> DataFrame:
    out = storage.scratch(spark, name)
    ST.write_stream(df, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/data")


@query("stream_endpoints")
def _(spark, d):
    pages = ST.read_stream(spark, f"{d}/pages.parquet", _PAGES)
    found = ST.extract(pages, lambda p: E.endpoints(p, path="url", text="html", context=False, method=False).select(*_EP))
    return _run(spark, found, "s1", "source_file string, url string, line_number int, endpoint_type string")


def _script_stream(spark: SparkSession, d: str) -> DataFrame:
    """Scripts derived from pages as they arrive, with a time that follows from the page's number."""
    ST.read_stream(spark, f"{d}/pages.parquet", _PAGES).createOrReplaceTempView("arriving_pages")
    made = TABLES["js_corpus"][0].replace("SELECT ", "SELECT page_id, ", 1).replace("FROM pages", "FROM arriving_pages")
    return spark.sql(made).select("path", "content", F.timestamp_seconds(F.col("page_id") % 24 * 600 + 1_699_999_200).alias("ts"))


@query("stream_first_seen")
def _(spark, d):
    """Items of scripts as they arrive, each (category, value) once; comments all stay."""
    found = I.js_items(_script_stream(spark, d).select("path", "content"))
    out = storage.scratch(spark, "s2")
    comments = F.col("category").isin(*WHOLE_TEXT)
    ST.write_first_seen(found, f"{out}/data", f"{out}/checkpoint", keys=["category", "value"], order=I.ORDER, through=comments).awaitTermination()
    return spark.read.schema("category string, value string, batch long").parquet(f"{out}/data").select("category", "value")


@query("stream_counts")
def _(spark, d):
    """Hourly findings by severity, of the windows the watermark has closed."""
    found = ST.with_time(_script_stream(spark, d), "ts", V.findings, "path", "file")
    counts = ST.windowed_counts(found, time="ts", by="severity")
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return _run(spark, counts.select(start, "severity", "n"), "s3", "window_start string, severity string, n bigint")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Distinct endpoints of pages and scripts, counted by type."""
    corpus = scripts_and_pages(spark, d)
    return E.count_by_type(E.dedup_endpoints(E.endpoints(corpus)))


__all__ = ["QUERIES", "flagship"]
