"""Tables derived from the given ones by SQL that Spark and DuckDB read alike.

They give every detector something to find.  Text that looks like a credential
is put together from pieces, so none is stored here.  The SQL holds no backslash
(the engines disagree on its meaning in literals): ``chr(92)`` stands for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


P = "CAST(page_id AS VARCHAR(20))"
_TITLE = "replace(regexp_extract(html, '<title>([^<]*)', 1), '@', ' ')"
HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
BS = "chr(92)"

# (keep where page_id % k = 0, SQL expression of one or more script lines)
_LINES: list[tuple[int, str]] = [
    (1, f"concat('// TODO page ', {P}, ' ', {_TITLE})"),
    (1, f"concat('const API_URL = \"/api/v', CAST(page_id % 3 AS VARCHAR(20)), '/items/', CAST(page_id % 17 AS VARCHAR(20)), '\";')"),
    (1, f"concat('fetch(\"/rest/users?id=', {P}, '&ref=x\").then(r => r.json());')"),
    (2, "concat('axios.post(\"/orders/', CAST(page_id % 11 AS VARCHAR(20)), '\", payload);')"),
    (3, "'el.innerHTML = data;'"),
    (4, "concat('eval(', 'code);')"),
    (5, "concat('import x from \"./lib/mod', CAST(page_id % 7 AS VARCHAR(20)), '.js\";')"),
    (6, "concat('/* jquery-3.', CAST(page_id % 9 AS VARCHAR(20)), '.1', chr(10), '   block */')"),
    (7, "concat('var ws = new WebSocket(\"wss://ws', CAST(page_id % 5 AS VARCHAR(20)), '.example.com/live\");')"),
    (8, "'console.log(\"http://cdn.example.com/a.png\");'"),
    (9, "concat('localStorage.setItem(\"', 'token', '\", v); window.location = \"/login\";')"),
    (10, "concat('const k = process.env.APP_KEY_', CAST(page_id % 4 AS VARCHAR(20)), '; Math.random();')"),
    (13, f"concat('var a = \"AK', 'IA', lpad({P}, 16, 'A'), '\";')"),
    # endpoints
    (3, f"concat('const t = `/tpl/', {P}, '/x`; let rel = \"../up/./c', {P}, '?x=1#f\";')"),
    (4, "'const q = graphql(\"/graphql/main\"); gql`query Users { id }`; gql`/graphql/frag`; graphql(\"query Users\");'"),
    (5, f"concat('img.src = \"//cdn', {P}, '.example.com/pic.png\"; url: \"https://h.example.com/e/f.,;\",')"),
    (6, "'require(\"../shared/util.js\"); import(\"./lazy.js\"); dynamic import(\"./dyn.js\"); location.href = \"https://www.example.com/next\";'"),
    (7, f"concat('axios({{ method: \"put\", x: 1 }}); var z = \"/after/put/', {P}, '\"; apiUrl = \"https://api.example.com/base/\";')"),
    (8, "'var s = \"ws://live.example.com/a\"; route = \"/r\"; endpoint: \"list/all\", path: \"a/../../b\", data = { a: 1 };'"),
    # items
    (5, "'function load(id, name) { return 1; } const add = (a, b) => a + b; let go = async (x) => x;'"),
    (6, "'var f1 = function(a) {}; export default function main() {} async function later() {} \"run\": function() {}, \"tick\": (x) => x, ''quoted'': async function() {}'"),
    (7, "'class Panel extends View {} new Widget(1); import React from \"react\"; import { a, b } from \"pkg/sub\"; import * as ns from \"ns\"; import \"side\";'"),
    (8, f"concat('x = \"C:', {BS}, 'temp', {BS}, 'file', {P}, '.txt\"; y = \"/assets/app.css\"; src=\"/img/logo.svg\"; href: \"/docs/index.html\";')"),
    (9, "'u = \"/list?page=1&size=2\"; this.route.params.id; req.query.term; ctx.body.name; options = { retries: 3 };'"),
    (10, f"concat('api_', 'key = \"', lpad({P}, 24, 'k'), '\"; pass', 'word: \"', 'open', {P}, '\"; auth', '_token = \"', repeat('t', 24), '\";')"),
    (11, f"concat('client_', 'secret: \"', lpad({P}, 24, 'c'), '\"; refresh_', 'token = \"', lpad({P}, 22, 'r'), '\"; firebase_', 'key = \"fb', {P}, '\"; maps_api_', 'key: \"m', {P}, '\";')"),
    (12, f"concat('h = \"Bearer ', repeat('b', 12), {P}, '\"; AWS_SECRET_', 'ACCESS_KEY=\"', repeat('z', 20), '\"; private_', 'key = \"-----BE', 'GIN RSA PRIVATE KEY-----', {P}, '\";')"),
    (13, f"concat('t1 = \"s', 'k_', lpad({P}, 24, 'a'), '\"; t2 = gh', 'p_', lpad({P}, 36, 'a'), '; t3 = gh', 'o_', lpad({P}, 36, 'b'), '; t4 = glp', 'at-', lpad({P}, 20, 'c'), ';')"),
    (14, f"concat('t5 = xo', 'xb-', lpad({P}, 12, '1'), '; t6 = \"ey', 'J', repeat('a', 10), '.ey', 'J', repeat('b', 10), '.', lpad({P}, 10, 'c'), '\";')"),
    (15, f"concat('k1 = S', 'G.', repeat('a', 22), '.', lpad({P}, 43, 'b'), '; k2 = A', 'C', lpad({P}, 32, 'd'), '; k3 = S', 'K', lpad({P}, 32, 'e'), ';')"),
    (16, f"concat('k4 = https://hooks.sl', 'ack.com/services/T', {P}, '/B1/x; k5 = AI', 'za', lpad({P}, 35, 'f'), '; k6 = ya', '29.', {P}, 'abc; k7 = EAAC', 'EdEose0cBA', {P}, 'x; k8 = np', 'm_', lpad({P}, 36, 'g'), ';')"),
    (7, "'document.getElementById(\"main\"); document.querySelectorAll(\".row\"); document.getElementsByClassName(\"cell\"); $(\"#nav\"); $$(\"a.b\"); document.title = \"Home\";'"),
    (8, "'el.on(\"click\", f); el.once(\"load\", f); el.addEventListener(\"message\", f); onclick = handle; @submit.prevent; el.focus = g;'"),
    (9, "'$.ajax({ url: \"/legacy\" }); new XMLHttpRequest(); axios.create(); axios.get(\"/z\"); $.get(\"/q\");'"),
    (10, "'io(\"https://sock.example.com\"); socket.emit(1); ws.send(x); new SockJS(\"/sock\");'"),
    (11, "'sessionStorage.getItem(\"sid\"); localStorage.removeItem(\"old\"); localStorage[\"theme\"]; sessionStorage[\"tab\"];'"),
    (12, "'document.cookie = \"a=b; path=/; Secure\"; Cookies.set(\"pref\", 1); setCookie(\"lang\", \"en\"); require(\"cookie-parser\");'"),
    (13, "'document.cookie = \"plain=1\";'"),
    (13, "'headers: { \"X-Id\": \"1\", a: 2 }, r.setHeader(\"X-Frame\", 1); \"Authorization\"; Accept: \"text/html\",'"),
    (11, "'new RegExp(\"ab+c\"); var re = /[a-z]+b/gi; var bad = /(a++)/; var worse = /(b*+)/; var fine = /(c+)+/;'"),
    (12, "'throw new TypeError(\"bad type\"); console.error(\"failed here\"); reject(\"nope here\"); console.warn(\"careful\");'"),
    (9, "'debugger; console.debug(1); /* FIXME later */ if (__DEV__) { mode = \"staging\"; }'"),
    (10, f"concat('// contact admin', {P}, '@mail.example.org or 10.0.', CAST(page_id % 200 AS VARCHAR(20)), '.7')"),
    (14, "'ip6 = fe80:0:0:0:a:b:c:d; db = \"postgresql://u@db.example.com/main\"; DATABASE_URL = \"mysql://db2/x\"; DB_HOST: \"db3\";'"),
    (15, "'import.meta.env.MODE_X; REACT_APP_NAME; NEXT_PUBLIC_URL; mutation AddUser { id }; subscription OnAdd($a: Int) { id }'"),
    (16, f"concat('blob = \"', repeat('QUJD', 12), lpad({P}, 8, '0'), '==\"; Access-Control-Allow-Origin: \"https://ok.example.com\"; cors({{ origin: 1 }});')"),
    (17, "'/** @version 1.2.3 */ /* @deprecated use other */ <!-- html note -->'"),
    (17, "'cfg.url = \"/cfg/one\"; baseURL: \"/base/two\"; route: \"/three\", ftp://files.example.com/a; localStorage[\"''odd\";'"),
    # rules
    (5, "'new Function(\"a\", s); setTimeout(\"go()\", 5); require(\"vm\"); vm.runInNewContext(s);'"),
    (6, "'el.outerHTML = s; document.writeln(s); el.insertAdjacentHTML(p, s); $(\"#a\").html(s); dangerouslySetInnerHTML;'"),
    (7, "'window.open(u); res.redirect(req.query.next); a.location.href = u;'"),
    (8, "'o.__proto__ = x; o.constructor[\"prototype\"]; o.constructor.prototype; function merge(a, b) { for (k in b) a[k] = b[k]; }'"),
    (9, "'xhr.open(\"GET\", u); w.postMessage(m, \"*\"); new WebSocket.Server({}); https.request(u); var h = \"http://localhost/x\";'"),
    (10, "'child_process.exec(\"ls \" + d); spawn(c); fs.readFile(\"/tmp/\" + n, cb); require(base + n);'"),
    (11, "'db.query(\"SELECT 1 query + x); db.execute(\"SELECT a\" + x); unserialize(z); s.unserialize(z); require(\"node-serialize\");'"),
    (12, "'libxmljs.x = 1; libxmljs(a).parse(b); col.findOne(req.body.q);'"),
    (13, "'createHash(\"md5\"); CryptoJS.MD5(x); createHash(''sha1''); CryptoJS.SHA1(x); \"aes-128-ecb\";'"),
    (14, f"concat('jwt.decode(t); jwt.sign(a, \"', 'hush', {P}, '\"); algorithms: [\"none\"]; token === other;')"),
    (15, f"concat('jwt.decode(t); verify(t); access_', 'token = \"', lpad({P}, 8, 'x'), '\"; -----BE', 'GIN PRIVATE KEY-----')"),
    (16, "'\"Access-Control-Allow-Origin\", \"*\"; introspection: true; nodeIntegration: true; contextIsolation: false;'"),
    (17, "concat('lodash@4.17.', CAST(page_id % 30 AS VARCHAR(20)), ' jquery 3.5.0; with (obj) { a = 1; } // with (x) { }')"),
    (1, "'class Widget extends Base {}'"),
]

JS_CORPUS = (
    f"SELECT concat('https://', {HOST}, '/static/app', {P}, CASE WHEN page_id % 12 = 5 THEN '.min.js' ELSE '.js' END) AS path,\n"
    " concat_ws(chr(10),\n  "
    + ",\n  ".join(e if k == 1 else f"CASE WHEN page_id % {k} = 0 THEN {e} END" for k, e in _LINES)
    + "\n ) AS content, 'js' AS kind FROM pages"
)

# Pages with an external script, a handler and a commented-out tag added to each.
RICH_PAGES = f"""
SELECT page_id, url, concat(html,
 '<!-- <script src="/dead.js"></script> --><script src="/static/app', {P}, '.js"></script>',
 CASE WHEN page_id % 2 = 0 THEN '<script type=module SRC=''lib/x.js?a=1&amp;b=2''></script>' ELSE '' END,
 CASE WHEN page_id % 3 = 0 THEN '<script>fetch("/inline/api?x=1"); var u = "https://cdn.example.com/p"; el.innerHTML = u;</script>' ELSE '' END,
 '<button class="b" onclick="go(''/btn/', {P}, ''')" onload=''open("/l/', CAST(page_id % 5 AS VARCHAR(20)), '")''>x</button>',
 CASE WHEN page_id % 5 = 0 THEN '<p onclick="no(''/p'')">t</p><a href="#top">a</a><a href="mailto:x">b</a><a href="">c</a>' ELSE '' END,
 CASE WHEN page_id % 4 = 0 THEN concat('<a title="> q" href="https://', {HOST}, '/same/', {P}, '">s</a><a href="https://other.example.net/x#f">o</a>') ELSE '' END,
 '<a href="/nav?x=1&amp;y=', {P}, '">n</a><a href="/caf&eacute;&#47;&#xe9;?a&#61;', {P}, '&nbsp;">e</a>') AS html
FROM pages"""

RESPONSES = """
SELECT concat('https://h', CAST(user_id % 20 AS VARCHAR(20)), '.example.com/p', CAST(user_id % 7 AS VARCHAR(20)), '?q=', CASE WHEN event_id % 2 = 0 THEN 'aa2a' ELSE 'bb1b' END) AS url,
 CASE WHEN user_id % 20 % 2 = 0 THEN '200' ELSE CASE event_type WHEN 'error' THEN '500' WHEN 'signup' THEN '302' WHEN 'purchase' THEN '403' ELSE '200' END END AS status,
 CASE WHEN user_id % 20 % 2 = 0 THEN '512' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20)) END AS length FROM events"""

URLS = """
SELECT url FROM pages UNION
SELECT concat(CASE WHEN c_custkey % 4 = 0 THEN 'http' ELSE 'https' END, '://', CASE c_custkey % 3 WHEN 0 THEN 'www' WHEN 1 THEN 'api' ELSE 'm' END, '.site', CAST(c_custkey % 9 AS VARCHAR(20)), CASE WHEN c_custkey % 6 = 0 THEN '.example.org:8443' ELSE '.example.com' END,
 CASE c_custkey % 8 WHEN 0 THEN '/api/v1/x.json' WHEN 1 THEN '/admin' WHEN 2 THEN '/a/b.php' WHEN 3 THEN '/static/app.js' WHEN 4 THEN '/.env' WHEN 5 THEN '/backup.sql' WHEN 6 THEN '/login/' ELSE '/' END,
 CASE WHEN c_custkey % 5 < 2 THEN concat('?id=', CAST(c_custkey AS VARCHAR(20)), '&sort-by=n') WHEN c_custkey % 5 = 2 THEN '#frag' ELSE '' END) AS url FROM customer"""

LINK_EDGES = " UNION ALL ".join(
    f"SELECT page_id AS src, (page_id * 7 + {k}) % (SELECT count(*) FROM pages) AS dst FROM pages" for k in (1, 2, 3)
)

# One row per language: file type, line marker, block markers, quote, escape.
_LANGUAGE_ROWS = [
    (0, ".html", "", "<!--", "-->", '"', "\\"), (1, ".css", "//", "/*", "*/", '"', "\\"),
    (2, ".ts", "//", "/*", "*/", "`", "\\"), (3, ".php", "#", "/*", "*/", '"', "\\"),
    (4, ".py", "#", "", "", '"""', "\\"), (5, ".go", "//", "/*", "*/", '"', "\\"),
    (6, ".rb", "#", "=begin", "=end", "`", "\\"), (7, ".sh", "#", "", "", "'", "\\"),
    (8, ".sql", "--", "/*", "*/", "'", "\\"), (9, ".ini", ";", "", "", '"', "\\"),
    (10, ".json5", "//", "/*", "*/", '"', "\\"), (11, "/Dockerfile", "#", "", "", '"', "\\"),
    (12, "/.vimrc", '"', "", "", "'", "\\"), (13, ".lua", "--", "--[[", "]]", '"', "\\"),
    (14, ".hs", "--", "{-", "-}", '"', "\\"), (15, ".clj", ";", "#|", "|#", '"', "\\"),
    (16, ".erl", "%", "", "", '"', "\\"), (17, ".f90", "!", "", "", '"', ""),
    (18, ".ps1", "#", "<#", "#>", '"', "`"), (19, ".bat", "REM", "", "", '"', ""),
    (20, ".bin", "#", "", "", '"', "\\"),
]


def _sql(text: str) -> str:
    return "chr(92)" if text == "\\" else "'" + text.replace("'", "''") + "'"


_VALUES = ", ".join(f"({i}, {', '.join(_sql(x) for x in rest)})" for i, *rest in _LANGUAGE_ROWS)

SOURCE_CORPUS = f"""
SELECT concat(CASE page_id % 11 WHEN 3 THEN 'node_modules/' WHEN 4 THEN 'site/build/' ELSE 'src/' END, 'f', {P},
  CASE WHEN page_id % 2 = 0 THEN upper(ext) ELSE ext END) AS path,
 concat_ws(chr(10),
  CASE WHEN ln <> '' THEN concat(ln, ' ', {_TITLE}) END,
  concat('x = ', q, 'a ', ln, b1, ' no', e, CASE WHEN e <> '' THEN q ELSE '' END, ' b', q, ' ', ln, ' tail ', {P}),
  CASE WHEN b1 <> '' THEN concat(b1, ' first ', {P}, chr(10), '  second ', {_TITLE}, ' ', b2, ' y = 1') END,
  CASE WHEN page_id % 5 = 0 THEN ln END,
  CASE WHEN page_id % 3 = 0 THEN concat('xREM no', chr(10), 'REMOVE ', {P}, chr(10), ':: note') END,
  CASE WHEN page_id % 4 = 0 AND b1 <> '' THEN concat('z ', b1, ' open ', {_TITLE}) END,
  CASE WHEN page_id % 4 = 1 THEN concat('end', chr(10), ln) END,
  CASE WHEN page_id % 4 = 2 AND b1 <> '' THEN b1 END
 ) AS content
FROM pages JOIN (VALUES {_VALUES}) AS l(i, ext, ln, b1, b2, q, e) ON page_id % 21 = l.i"""

TABLES = {
    "js_corpus": (JS_CORPUS, ["pages"]),
    "rich_pages": (RICH_PAGES, ["pages"]),
    "responses": (RESPONSES, ["events"]),
    "urls": (URLS, ["pages", "customer"]),
    "link_edges": (LINK_EDGES, ["pages"]),
    "source_corpus": (SOURCE_CORPUS, ["pages"]),
}
SCOPE = ["*.example.com", "api.*.example.org:8443", "WWW.site1.example.com", "", "# remark"]


#: Session setting: tasks over which the text tables are dealt. Not set, they are read as they are stored.
PARTITIONS = "pagesieve.partitions"
TEXT_TABLES = ("pages", "documents")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    wanted = spark.conf.get(PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted and name in TEXT_TABLES else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, or a derived one worked out from the given ones."""
    if name not in TABLES:
        return read(spark, folder, name)
    sql, needs = TABLES[name]
    for n in needs:
        read(spark, folder, n).createOrReplaceTempView(n)
    return spark.sql(sql)
