"""Static-analysis rules for scripts; each belongs to a topic."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pagesieve.functions.regex import Rx

# Severity ranks, and substrings that hint at user-controlled data.
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}
TAINT_HINTS = [
    "req.body", "req.query", "req.params", "req.headers", "req.cookies",
    "location.search", "location.hash", "location.href",
    "document.URL", "document.documentURI", "document.referrer",
    "window.name", "localStorage.getItem", "sessionStorage.getItem",
    "request.body", "request.query", "request.params", "input", "userInput",
    "data", "payload", "JSON.parse", "URLSearchParams",
]
# Lines looked at before and after a match for a hint, snippet width.
TAINT_BEFORE, TAINT_AFTER, SNIPPET = 4, 5, 200


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    cwe: str
    tags: tuple[str, ...]
    rx: Rx
    title: str
    description: str
    remediation: str
    group: str = ""
    taint: bool = False
    below: tuple[int, int, int] | None = None  # fires only under this version


def _rule(group, rule_id, severity, cwe, tags, pattern, needs, title, description, remediation, *,
          flags="", java=None, re2=None, taint=False, below=None, idle=None):
    rx = Rx(pattern, needs, flags, java, re2, idle)
    return Rule(rule_id, severity, cwe, tuple(tags), rx, title, description, remediation, group, taint, below)


# Ids, severities, CWE numbers, tags and expressions, in evaluation order, which breaks ties when
# sorting.  Topics, titles and advice are this library's own.
_RULES: list[Rule] = [
    _rule("code_exec", "JS-EVAL-001", "HIGH", "CWE-95", ["rce", "code-injection"],
          r"""\beval\s*\(""", ("eval",),
          "eval call", "Runs a string as code.", "Parse the data instead of evaluating it."),
    _rule("code_exec", "JS-FUNCTION-CTOR-001", "HIGH", "CWE-95", ["rce"],
          r"""\bnew\s+Function\s*\(""", ("Function",),
          "Function built from text", "Compiles a string into a function.", "Write the function in code."),
    _rule("code_exec", "JS-SETTIMEOUT-STRING-001", "MEDIUM", "CWE-95", ["rce", "code-injection"],
          r"""\b(setTimeout|setInterval)\s*\(\s*(['\"])""", ("setTimeout", "setInterval"),
          "Timer given a string", "A string timer body is evaluated.", "Pass a function to the timer."),
    _rule("code_exec", "NODE-VM-001", "HIGH", "CWE-913", ["rce", "sandbox-escape"],
          r"""\brequire\s*\(\s*['\"]vm['\"]\s*\)|\bvm\.(runInThisContext|runInNewContext|Script)\b""", ("vm",),
          "vm module in use", "The vm module does not isolate code.", "Run foreign code in a real sandbox."),
    _rule("xss", "JS-INNERHTML-001", "HIGH", "CWE-79", ["xss", "dom"],
          r"""\.innerHTML\s*=""", (".innerHTML",),
          "innerHTML assigned", "Markup is parsed from the value.", "Assign text or sanitise first."),
    _rule("xss", "JS-OUTERHTML-001", "HIGH", "CWE-79", ["xss"],
          r"""\.outerHTML\s*=""", (".outerHTML",),
          "outerHTML assigned", "Replaces a node by parsed markup.", "Build nodes instead of markup."),
    _rule("xss", "JS-DOCUMENT-WRITE-001", "HIGH", "CWE-79", ["xss", "dom"],
          r"""\bdocument\.(write|writeln)\s*\(""", ("document.write",),
          "document.write call", "Writes raw markup to the page.", "Append created elements."),
    _rule("xss", "JS-INSERTADJACENTHTML-001", "HIGH", "CWE-79", ["xss"],
          r"""\.insertAdjacentHTML\s*\(""", (".insertAdjacentHTML",),
          "insertAdjacentHTML call", "Inserts parsed markup.", "Sanitise the markup first."),
    _rule("xss", "JS-JQUERY-HTML-001", "MEDIUM", "CWE-79", ["xss"],
          r"""\$\(.*\)\.html\s*\(""", (").html",),
          "jQuery html setter", "Sets parsed markup through jQuery.", "Use the text setter.",
          idle=r"""\$\(.*+"""),
    _rule("xss", "JS-DANGEROUSLYSETINNERHTML-001", "MEDIUM", "CWE-79", ["xss", "react"],
          r"""dangerouslySetInnerHTML""", ("dangerouslySetInnerHTML",),
          "React raw markup", "Turns off escaping for a node.", "Render text, or sanitise."),
    _rule("xss", "JS-DOCUMENT-LOCATION-HREF-001", "MEDIUM", "CWE-601", ["open-redirect", "xss"],
          r"""(\.location(\.href)?|window\.location)\s*=""", (".location",),
          "Location assigned", "Navigates to a computed address.", "Allow only known schemes and hosts."),
    _rule("xss", "JS-WINDOW-OPEN-001", "LOW", "CWE-601", ["open-redirect"],
          r"""\bwindow\.open\s*\(""", ("window.open",),
          "window.open call", "Opens a computed address.", "Check the scheme of the address.", taint=True),
    _rule("proto", "JS-PROTO-ASSIGN-001", "HIGH", "CWE-1321", ["prototype-pollution"],
          r"""__proto__\s*[:=]""", ("__proto__",),
          "__proto__ written", "May change every object.", "Use maps or objects without prototype."),
    _rule("proto", "JS-CONSTRUCTOR-PROTO-001", "MEDIUM", "CWE-1321", ["prototype-pollution"],
          r"""\.constructor\s*\[\s*['\"]prototype['\"]\s*\]|\.constructor\.prototype\b""", (".constructor",),
          "constructor.prototype reached", "A path to the shared prototype.", "Refuse this key when merging."),
    _rule("proto", "JS-OBJECT-ASSIGN-DEEP-001", "MEDIUM", "CWE-1321", ["prototype-pollution"],
          r"""function\s+\w+\s*\([^)]*\)\s*\{[^}]*for\s*\([^)]*in\s+\w+\)[^}]*\[\w+\]\s*=""", ("function",),
          "Hand-written merge loop", "Copies keys without a check.", "Skip prototype keys.", flags="s"),
    _rule("request", "JS-FETCH-001", "LOW", "CWE-918", ["ssrf"],
          r"""\bfetch\s*\(""", ("fetch",),
          "fetch near user data", "The address may be chosen by a user.", "Check host and scheme.", taint=True),
    _rule("request", "JS-XHR-OPEN-001", "LOW", "CWE-918", ["ssrf"],
          r"""\.open\s*\(\s*['\"](?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)['\"]""", (".open",),
          "Request opened near user data", "The address may be chosen by a user.", "Check the target origin.", taint=True),
    _rule("request", "JS-POSTMESSAGE-001", "MEDIUM", "CWE-345", ["postmessage", "xss"],
          r"""\.addEventListener\s*\(\s*['\"]message['\"]""", (".addEventListener",),
          "Message listener", "Any window may send messages.", "Compare the sender's origin."),
    _rule("request", "JS-POSTMESSAGE-WILDCARD-001", "MEDIUM", "CWE-345", ["postmessage"],
          r"""\.postMessage\s*\([^,]+,\s*['\"]\*['\"]""", (".postMessage",),
          "Message sent to any origin", "Every window can read it.", "Name the receiving origin."),
    _rule("node", "NODE-EXEC-001", "HIGH", "CWE-78", ["command-injection", "rce"],
          r"""(?:child_process\.)?(exec|execSync)\s*\([^)]*\+""", ("exec",),
          "Shell command concatenated", "The command line is built from parts.", "Pass an argument list.",
          idle=r"""(?:child_process\.)?(?:exec|execSync)\s*\([^)]*+"""),
    _rule("node", "NODE-EXEC-002", "MEDIUM", "CWE-78", ["command-injection"],
          r"""(?:child_process\.)?\b(exec|execSync|spawn|spawnSync|fork|execFile)\b""", ("exec", "spawn", "fork"),
          "Process started near user data", "Arguments may be chosen by a user.", "Validate the arguments.", taint=True),
    _rule("node", "NODE-PATH-001", "HIGH", "CWE-22", ["path-traversal"],
          r"""\bfs\.(readFile|readFileSync|writeFile|writeFileSync|appendFile|unlink|createReadStream|createWriteStream|readdir|stat|lstat|access)\s*\([^)]*\+""", ("fs.",),
          "File path concatenated", "The path may leave its folder.", "Resolve and compare with the root.",
          idle=r"""\bfs\.(?:readFile|readFileSync|writeFile|writeFileSync|appendFile|unlink|createReadStream|createWriteStream|readdir|stat|lstat|access)\s*\([^)]*+"""),
    _rule("node", "NODE-REQUIRE-DYNAMIC-001", "HIGH", "CWE-94", ["lfi", "code-injection"],
          r"""\brequire\s*\(\s*[^'\"][^)]*\+""", ("require",),
          "Module name computed", "Any file may be loaded.", "Map names to listed modules.",
          idle=r"""\brequire\s*\([^)+]*+(?:\z|(?<!\(\s{0,40})(?=\)))"""),
    _rule("node", "NODE-SQL-CONCAT-001", "HIGH", "CWE-89", ["sqli"],
          r"""\.(query|execute)\s*\(\s*(['\"])(SELECT|INSERT|UPDATE|DELETE|DROP|UNION)[^'\"]*\1\s*\+""", (".query", ".execute"),
          "SQL text concatenated", "Values become part of the statement.", "Use bound parameters.", flags="i",
          re2=r"""\.query\s*\(\s*['\"](?:SELECT|INSERT|UPDATE|DELETE|DROP|UNION)[^'\"]*query\s*\+|\.execute\s*\(\s*['\"](?:SELECT|INSERT|UPDATE|DELETE|DROP|UNION)[^'\"]*execute\s*\+"""),
    _rule("node", "JS-REDOS-001", "MEDIUM", "CWE-1333", ["redos"],
          r"""\(((?:[^()\\]|\\.)*)\+[\+\*]\)|\(((?:[^()\\]|\\.)*)\*[\+\*]\)""", ("+)", "*)"),
          "Nested quantifier", "May take exponential time.", "Rewrite without nesting.",
          java=r"""\((?:(?!\+[+*]\))(?:[^()\\]|\\.))*+\+[+*]\)|\((?:(?!\*[+*]\))(?:[^()\\]|\\.))*+\*[+*]\)"""),
    _rule("crypto", "JS-MD5-001", "MEDIUM", "CWE-327", ["crypto"],
          r"""\b(createHash\s*\(\s*['\"]md5['\"]|CryptoJS\.MD5|forge\.md)\b""", ("md5", "forge.md"),
          "MD5 in use", "Collisions are practical.", "Use SHA-256 or better.", flags="i"),
    _rule("crypto", "JS-SHA1-001", "LOW", "CWE-327", ["crypto"],
          r"""\b(createHash\s*\(\s*['\"]sha1['\"]|CryptoJS\.SHA1)\b""", ("sha1",),
          "SHA-1 in use", "Collisions are practical.", "Use SHA-256 or better.", flags="i"),
    _rule("crypto", "JS-MATH-RANDOM-001", "MEDIUM", "CWE-338", ["crypto", "prng"],
          r"""\bMath\.random\b""", ("Math.random",),
          "Predictable random numbers", "Values can be guessed.", "Use the crypto generator."),
    _rule("crypto", "JS-ECB-MODE-001", "HIGH", "CWE-327", ["crypto"],
          r"""['\"](aes|des)-(\d+)?-?ecb['\"]""", ("ecb",),
          "ECB cipher mode", "Equal blocks stay equal.", "Use an authenticated mode.", flags="i"),
    _rule("crypto", "JS-COOKIE-INSECURE-001", "MEDIUM", "CWE-1004", ["cookie"],
          r"""document\.cookie\s*=\s*[^;]+(;[^;]*)?(?!.*(?:secure|httponly|samesite))""", ("document.cookie",),
          "Cookie without protection", "No attribute limits the cookie.", "Set Secure and SameSite.", flags="i",
          re2=r"""document\.cookie\s*=\s*[^;]+(;[^;]*)?"""),
    _rule("crypto", "JS-LOCALSTORAGE-SECRET-001", "MEDIUM", "CWE-922", ["secrets"],
          r"""localStorage\.setItem\s*\(\s*['\"](?:token|jwt|secret|password|apikey|api_key|auth)['\"]""", ("localstorage.setitem",),
          "Credential in local storage", "Any script of the page can read it.", "Keep it in a protected cookie.", flags="i"),
    _rule("secrets", "SECRET-AWS-001", "CRITICAL", "CWE-798", ["secret", "aws"],
          r"""\b(AKIA|ASIA|AGPA|AIDA|AROA|ANPA|ANVA|AIPA)[0-9A-Z]{16}\b""", ("AKIA", "ASIA", "AGPA", "AIDA", "AROA", "ANPA", "ANVA", "AIPA"),
          "AWS key id in source", "Grants access to an account.", "Revoke it and use a secret store."),
    _rule("secrets", "SECRET-GITHUB-001", "CRITICAL", "CWE-798", ["secret", "github"],
          r"""\bgh[pousr]_[A-Za-z0-9]{36}\b""", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
          "GitHub token in source", "Grants access to repositories.", "Revoke it and use a secret store."),
    _rule("secrets", "SECRET-GOOGLE-001", "HIGH", "CWE-798", ["secret", "google"],
          r"""\bAIza[0-9A-Za-z\-_]{35}\b""", ("AIza",),
          "Google key in source", "Can be used by others.", "Restrict and rotate the key."),
    _rule("secrets", "SECRET-JWT-001", "HIGH", "CWE-798", ["secret", "jwt"],
          r"""\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\b""", ("eyJ",),
          "Signed token in source", "May still be valid.", "Remove it and rotate the key."),
    _rule("secrets", "SECRET-PRIVATE-KEY-001", "CRITICAL", "CWE-798", ["secret", "pki"],
          r"""-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----""", ("PRIVATE KEY-----",),
          "Private key in source", "Identifies its owner.", "Replace the key pair."),
    _rule("secrets", "SECRET-GENERIC-001", "MEDIUM", "CWE-798", ["secret"],
          r"""\b(password|passwd|pwd|secret|api[_\-]?key|auth[_\-]?token|access[_\-]?token)\b\s*[:=]\s*['\"][^'\"]{6,}['\"]""",
          ("password", "passwd", "pwd", "secret", "api", "token"),
          "Credential assigned in source", "A literal looks like a credential.", "Load it at run time.", flags="i"),
    _rule("config", "JS-CORS-WILDCARD-001", "HIGH", "CWE-942", ["cors"],
          r"""Access-Control-Allow-Origin['\"]?\s*[:,]\s*['\"]\*['\"]""", ("access-control-allow-origin",),
          "Any origin allowed", "Other sites may read responses.", "List the origins.", flags="i"),
    _rule("config", "JS-DEBUGGER-001", "LOW", "CWE-489", ["debug"],
          r"""\bdebugger\b\s*;?""", ("debugger",),
          "debugger statement", "Stops the page in developer tools.", "Remove the statement."),
    _rule("config", "JS-CONSOLE-LOG-001", "INFO", "CWE-532", ["info-disclosure"],
          r"""\bconsole\.(log|debug|info|warn)\s*\(""", ("console.",),
          "Console output", "May show internal data.", "Drop it from releases."),
    _rule("deps", "DEP-JQUERY-OLD-001", "HIGH", "CWE-79", ["dependency"],
          r"""jquery[^\d]{0,10}(\d+)\.(\d+)\.(\d+)""", ("jquery",),
          "Old jQuery", "Known markup injection.", "Use 3.5.0 or later.", below=(3, 5, 0)),
    _rule("deps", "DEP-LODASH-OLD-001", "HIGH", "CWE-1321", ["dependency"],
          r"""lodash[^\d]{0,10}(\d+)\.(\d+)\.(\d+)""", ("lodash",),
          "Old lodash", "Known prototype pollution.", "Use 4.17.21 or later.", below=(4, 17, 21)),
    _rule("node", "NODE-DESERIALIZE-001", "CRITICAL", "CWE-502", ["deserialization", "rce"],
          r"""\brequire\s*\(\s*['\"]node-serialize['\"]\s*\)|\.unserialize\s*\(""", ("node-serialize", ".unserialize"),
          "Code-carrying deserialiser", "The input may hold code.", "Read plain JSON."),
    _rule("crypto", "JS-JWT-NONE-ALG-001", "CRITICAL", "CWE-347", ["jwt", "auth-bypass"],
          r"""algorithms?\s*:\s*\[?\s*['\"]none['\"]|jwt\.decode\s*\([^)]*\)\s*(?!.*verify)""", ("algorithm", "jwt.decode"),
          "Token accepted unverified", "The signature is not checked.", "Verify with a fixed algorithm.",
          re2=r"""algorithms?\s*:\s*\[?\s*['\"]none['\"]|jwt\.decode\s*\([^)]*\)"""),
    _rule("crypto", "JS-JWT-HARDCODED-SECRET-001", "HIGH", "CWE-798", ["jwt", "secret"],
          r"""jwt\.(sign|verify)\s*\([^)]*,\s*['\"][^'\"]{4,}['\"]""", ("jwt.sign", "jwt.verify"),
          "Signing secret in source", "Tokens can be forged.", "Load the secret at run time."),
    _rule("node", "NODE-XXE-001", "HIGH", "CWE-611", ["xxe"],
          r"""\b(libxmljs|xml2js|sax)\b.*\bparse""", ("libxmljs", "xml2js", "sax"),
          "XML parsed near user data", "External entities may be resolved.", "Turn external entities off.", taint=True,
          idle=r"""\b(?:libxmljs|xml2js|sax)\b.*+"""),
    _rule("request", "NODE-HTTP-REQUEST-001", "LOW", "CWE-918", ["ssrf"],
          r"""\b(http|https)\.request\s*\(""", (".request",),
          "Outgoing request near user data", "The host may be chosen by a user.", "Allow listed hosts only.", taint=True),
    _rule("xss", "JS-OPEN-REDIRECT-001", "MEDIUM", "CWE-601", ["open-redirect"],
          r"""res\.redirect\s*\(\s*req\.(query|body|params)""", ("res.redirect",),
          "Redirect taken from the request", "The client chooses the destination.", "Redirect to listed paths only."),
    _rule("crypto", "JS-INSECURE-COMPARE-001", "LOW", "CWE-208", ["timing-attack"],
          r"""\b(token|secret|hmac|signature)\w*\s*===?\s*""", ("token", "secret", "hmac", "signature"),
          "Secret compared plainly", "Timing reveals the value.", "Compare in constant time.", taint=True),
    _rule("config", "JS-GRAPHQL-INTROSPECTION-001", "LOW", "CWE-200", ["graphql", "info-disclosure"],
          r"""introspection\s*:\s*true""", ("introspection",),
          "GraphQL introspection on", "Shows the whole schema.", "Turn it off in production."),
    _rule("config", "ELECTRON-NODEINTEGRATION-001", "HIGH", "CWE-829", ["electron", "rce"],
          r"""nodeIntegration\s*:\s*true""", ("nodeIntegration",),
          "Node in the renderer", "Page scripts reach the system.", "Turn it off and isolate contexts."),
    _rule("config", "ELECTRON-CONTEXTISOLATION-001", "MEDIUM", "CWE-829", ["electron"],
          r"""contextIsolation\s*:\s*false""", ("contextIsolation",),
          "Context isolation off", "Page and preload share objects.", "Turn isolation on."),
    _rule("request", "JS-WEBSOCKET-NO-ORIGIN-001", "MEDIUM", "CWE-346", ["websocket"],
          r"""new\s+WebSocket\.Server\s*\(""", ("WebSocket.Server",),
          "Socket server", "The handshake may accept any origin.", "Check the origin of the handshake.", taint=True),
    _rule("request", "JS-HTTP-INSECURE-URL-001", "LOW", "CWE-319", ["transport-security"],
          r"""['\"]http://(?!localhost|127\.0\.0\.1)[^'\"]+['\"]""", ("http://",),
          "Plain HTTP address", "Traffic can be read and changed.", "Use HTTPS.",
          re2=r"""['\"]http://[^'\"]+['\"]"""),
    _rule("node", "NODE-NOSQL-INJECTION-001", "HIGH", "CWE-943", ["nosql-injection"],
          r"""\.(find|findOne|update|updateOne|deleteOne)\s*\(\s*req\.(body|query|params)""", (".find", ".update", ".deleteOne"),
          "Request used as a query", "Operators may be injected.", "Validate against a schema."),
]

# The check for `with` statements reads code only, so it runs over text whose
# comments and strings are blanked out (see operators.findings).
WITH_RULE = _rule("", "JS-WITH-001", "LOW", "CWE-1078", ["style", "strict-mode"],
                  r"""\bwith\s*\([^)]*\)\s*\{""", ("with",),
                  "with statement", "Names resolve at run time.", "Name the object explicitly.")

# The intended reading of expressions that, as specified, miss what they are for.
_CORRECTED = {
    "NODE-SQL-CONCAT-001": Rx(
        r"""\.(?:query|execute)\s*\(\s*(?:'(?:SELECT|INSERT|UPDATE|DELETE|DROP|UNION)[^'\"]*'|\"(?:SELECT|INSERT|UPDATE|DELETE|DROP|UNION)[^'\"]*\")\s*\+""",
        (".query", ".execute"), "i"),
    "JS-COOKIE-INSECURE-001": Rx(
        r"""document\.cookie\s*=(?![^\n]*(?:secure|httponly|samesite))[^\n;]*""", ("document.cookie",), "i"),
    "JS-REDOS-001": Rx(r"""\([^()\\]*[+*]\)[+*]""", (")+", ")*")),
    "JS-MD5-001": Rx(r"""\b(?:createHash\s*\(\s*['\"]md5['\"]|CryptoJS\.MD5\b|forge\.md\b)""", ("md5", "forge.md"), "i"),
    "JS-SHA1-001": Rx(r"""\b(?:createHash\s*\(\s*['\"]sha1['\"]|CryptoJS\.SHA1\b)""", ("sha1",), "i"),
}

GROUPS = list(dict.fromkeys(r.group for r in _RULES))


def rules(groups: list[str] | None = None, include_info: bool = True, corrected: bool = False) -> list[Rule]:
    """The rules to run, in evaluation order, chosen before anything is scanned."""
    chosen = [r for r in _RULES if (groups is None or r.group in groups) and (include_info or r.severity != "INFO")]
    return [replace(r, rx=_CORRECTED.get(r.rule_id, r.rx)) if corrected else r for r in chosen]
