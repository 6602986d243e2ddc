"""Line-local detectors for scripts: 27 categories, plus the whole-text comment detectors."""

from pagesieve.functions.regex import Rx

# Confidence order, strongest first.
CONFIDENCE_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}

_QUOTES = ('"', "'")

# Category -> (expression, confidence) in evaluation order.  Values
# come from group 1, or from the whole match where there is no group.  `secrets`
# ignores case; elsewhere the dot matches anything on the line.
_SPEC: dict[str, list[tuple[str, str, tuple[str, ...]]]] = {
    "api_endpoints": [
        (r"""["']([/][a-zA-Z0-9_\-./{}:]+(?:api|v[0-9]+|rest|graphql|endpoint)[a-zA-Z0-9_\-./{}:]*)["']""", "high", ("'/", '"/')),
        (r"""["']([/][a-zA-Z0-9_\-./{}:]+)["']\s*[,\)]""", "medium", ("'/", '"/')),
        (r"""(?:url|path|endpoint|route|href|src|action)\s*[:=]\s*["']([^"']+)["']""", "high", ("url", "path", "endpoint", "route", "href", "src", "action")),
        (r"""(?:fetch|axios|request|get|post|put|delete|patch)\s*\(\s*["']([^"']+)["']""", "high", ("fetch", "axios", "request", "get", "post", "put", "delete", "patch")),
        (r"""\.url\s*=\s*["']([^"']+)["']""", "high", (".url",)),
        (r"""baseURL\s*[:=]\s*["']([^"']+)["']""", "high", ("baseURL",)),
        (r"""["'](?:/api/|/v[0-9]+/|/rest/|/graphql)[^"']*["']""", "high", ("'/", '"/')),
        (r"""path:\s*["']([^"']+)["']""", "high", ("path:",)),
        (r"""route:\s*["']([^"']+)["']""", "high", ("route:",)),
    ],
    "file_paths": [
        (r"""["']([a-zA-Z]:\\[^\"]+)["']""", "high", (":\\",)),
        (r"""["'](?:\.\./|\./|/)[a-zA-Z0-9_\-./]+\.[a-zA-Z]{2,5}["']""", "high", ("'/", '"/', "'./", '"./', "'../", '"../')),
        (r"""["'](/[a-zA-Z0-9_\-./]+\.[a-zA-Z]{2,5})["']""", "high", ("'/", '"/')),
        (r"""(?:require|import|include)\s*\(\s*["']([^"']+)["']\s*\)""", "high", ("require", "import", "include")),
        (r"""from\s+["']([^"']+)["']""", "high", ("from",)),
        (r"""src\s*[:=]\s*["']([^"']+\.[a-zA-Z]{2,5})["']""", "medium", ("src",)),
        (r"""href\s*[:=]\s*["']([^"']+\.[a-zA-Z]{2,5})["']""", "medium", ("href",)),
    ],
    "parameters": [
        (r"""function\s+[a-zA-Z_$][a-zA-Z0-9_$]*\s*\(([^)]+)\)""", "high", ("function",)),
        (r"""(?:const|let|var)\s+[a-zA-Z_$][a-zA-Z0-9_$]*\s*=\s*\(([^)]+)\)\s*=>""", "high", ("=>",)),
        (r"""\(\s*([a-zA-Z_$][a-zA-Z0-9_$,\s]*)\s*\)\s*=>""", "high", ("=>",)),
        (r"""(?:params|query|body|data|options|config|args)\s*[:=]\s*\{([^}]+)\}""", "high", ("params", "query", "body", "data", "options", "config", "args")),
        (r"""\?[a-zA-Z_][a-zA-Z0-9_]*=""", "medium", ("?",)),
        (r"""(?:this\.)?[a-zA-Z_$][a-zA-Z0-9_$]*\.params\.[a-zA-Z_$][a-zA-Z0-9_$]*""", "high", (".params.",)),
        (r"""(?:req|request|ctx)\.(?:query|body|params)\.[a-zA-Z_$][a-zA-Z0-9_$]*""", "high", (".query.", ".body.", ".params.")),
    ],
    "secrets": [
        (r"""(?:api[_-]?key|apikey|api[_-]?secret)\s*[:=]\s*["']([a-zA-Z0-9_\-]{20,})["']""", "critical", ("api",)),
        (r"""(?:password|passwd|pwd)\s*[:=]\s*["']([^"']{4,})["']""", "critical", ("password", "passwd", "pwd")),
        (r"""(?:secret|token|auth)[_-]?(?:key)?\s*[:=]\s*["']([a-zA-Z0-9_\-\.]{20,})["']""", "critical", ("secret", "token", "auth")),
        (r"""(?:Bearer|Token|Basic)\s+["']?([a-zA-Z0-9_\-\.]+)""", "high", ("bearer", "token", "basic")),
        (r"""(?:AWS|aws)[_-]?(?:SECRET|secret)[_-]?(?:ACCESS|access)[_-]?(?:KEY|key)\s*[:=]\s*["']([^"']+)["']""", "critical", ("aws",)),
        (r"""(?:PRIVATE|private)[_-]?(?:KEY|key)\s*[:=]\s*["']-----BEGIN[^"']+["']""", "critical", ("-----begin",)),
        (r"""["'](?:sk|pk|rk)_[a-zA-Z0-9]{20,}["']""", "critical", ("sk_", "pk_", "rk_")),
        (r"""ghp_[a-zA-Z0-9]{36,}""", "critical", ("ghp_",)),
        (r"""gho_[a-zA-Z0-9]{36,}""", "critical", ("gho_",)),
        (r"""glpat-[a-zA-Z0-9\-]{20,}""", "critical", ("glpat-",)),
        (r"""xox[bpsa]-[a-zA-Z0-9\-]{10,}""", "critical", ("xox",)),
        (r"""AKIA[0-9A-Z]{16}""", "critical", ("akia",)),
        (r"""["']eyJ[a-zA-Z0-9_\-]+\.eyJ[a-zA-Z0-9_\-]+\.[a-zA-Z0-9_\-]+["']""", "high", ("eyj",)),
        (r"""client[_-]?secret\s*[:=]\s*["']([a-zA-Z0-9_\-]{20,})["']""", "critical", ("client",)),
        (r"""refresh[_-]?token\s*[:=]\s*["']([a-zA-Z0-9_\-\.]{20,})["']""", "critical", ("refresh",)),
        (r"""firebase[_-]?key\s*[:=]\s*["']([^"']+)["']""", "high", ("firebase",)),
        (r"""maps[_-]?api[_-]?key\s*[:=]\s*["']([^"']+)["']""", "high", ("maps",)),
    ],
    "urls": [
        (r"""https?://[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+""", "high", ("://",)),
        (r"""wss?://[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+""", "high", ("://",)),
        (r"""ftp://[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+""", "high", ("ftp://",)),
    ],
    "function_names": [
        (r"""(?:function|async\s+function)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)""", "high", ("function",)),
        (r"""(?:const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*=\s*(?:async\s+)?\(""", "high", ("const", "let", "var")),
        (r"""(?:const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>)""", "high", ("const", "let", "var")),
        (r"""(["'])([a-zA-Z_$][a-zA-Z0-9_$]*)\1\s*:\s*(?:async\s+)?function""", "high", ("function",)),
        (r"""(?:export\s+)?(?:default\s+)?function\s+([a-zA-Z_$][a-zA-Z0-9_$]*)""", "high", ("function",)),
        (r"""["']([a-zA-Z_$][a-zA-Z0-9_$]*)["']\s*:\s*\(""", "medium", _QUOTES),
    ],
    "class_names": [
        (r"""class\s+([a-zA-Z_$][a-zA-Z0-9_$]*)""", "high", ("class",)),
        (r"""extends\s+([a-zA-Z_$][a-zA-Z0-9_$]*)""", "high", ("extends",)),
        (r"""new\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\(""", "medium", ("new",)),
    ],
    "imports": [
        (r"""import\s+(?:\{[^}]*\}|\*\s+as\s+[a-zA-Z_$][a-zA-Z0-9_$]*|[a-zA-Z_$][a-zA-Z0-9_$]*)\s+from\s+["']([^"']+)["']""", "high", ("import",)),
        (r"""import\s+["']([^"']+)["']""", "high", ("import",)),
        (r"""(?:require|import)\s*\(\s*["']([^"']+)["']\s*\)""", "high", ("require", "import")),
        (r"""dynamic\s+import\s*\(\s*["']([^"']+)["']\s*\)""", "high", ("dynamic",)),
    ],
    "comments": [
        (r"""//[^\n]*""", "medium", ("//",)),
        (r"""/\*[\s\S]*?\*/""", "medium", ("/*",)),
        (r"""<!\-\-[\s\S]*?\-\->""", "medium", ("<!--",)),
    ],
    "dom_selectors": [
        (r"""(?:getElementById|querySelector|querySelectorAll)\s*\(\s*["']([^"']+)["']""", "high", ("getElementById", "querySelector")),
        (r"""(?:getElementsByClassName|getElementsByTagName)\s*\(\s*["']([^"']+)["']""", "high", ("getElementsBy",)),
        (r"""\$\s*\(\s*["']([^"']+)["']""", "high", ("$",)),
        (r"""\$\$\s*\(\s*["']([^"']+)["']""", "high", ("$$",)),
        (r"""document\.[a-zA-Z]+\s*=\s*["']([^"']+)["']""", "medium", ("document.",)),
    ],
    "event_handlers": [
        (r"""\.on\s*\(\s*["']([a-zA-Z]+)["']""", "high", (".on",)),
        (r"""\.addEventListener\s*\(\s*["']([a-zA-Z]+)["']""", "high", (".addEventListener",)),
        (r"""\.once\s*\(\s*["']([a-zA-Z]+)["']""", "high", (".once",)),
        (r"""on[a-zA-Z]+\s*=\s*(?:function|[a-zA-Z_$])""", "medium", ("on",)),
        (r"""@([a-zA-Z]+\.[a-zA-Z]+)""", "medium", ("@",)),
        (r"""\.(click|submit|change|input|keyup|keydown|mouseover|mouseout|load|error|focus|blur)\s*=""", "high", (".click", ".submit", ".change", ".input", ".key", ".mouse", ".load", ".error", ".focus", ".blur")),
    ],
    "ajax_calls": [
        (r"""(?:fetch|axios|XMLHttpRequest|\.ajax|\.get|\.post|\.put|\.delete|\.patch)\s*\(""", "high", ("fetch", "axios", "XMLHttpRequest", ".ajax", ".get", ".post", ".put", ".delete", ".patch")),
        (r"""\$\.ajax\s*\(\s*\{""", "high", ("$.ajax",)),
        (r"""new\s+XMLHttpRequest""", "high", ("XMLHttpRequest",)),
        (r"""axios\.(?:create|get|post|put|delete|patch|request|all|spread)""", "high", ("axios.",)),
    ],
    "websockets": [
        (r"""new\s+(?:WebSocket|SockJS|Socket\.IO|io)\s*\(\s*["']([^"']+)["']""", "high", ("new",)),
        (r"""(?:socket|ws|wss)\.?(?:connect|on|emit|send)\s*\(""", "medium", ("socket", "ws")),
        (r"""io\s*\(\s*["']([^"']+)["']""", "high", ("io",)),
    ],
    "local_storage_keys": [
        (r"""localStorage\.(?:getItem|setItem|removeItem)\s*\(\s*["']([^"']+)["']""", "high", ("localStorage",)),
        (r"""sessionStorage\.(?:getItem|setItem|removeItem)\s*\(\s*["']([^"']+)["']""", "high", ("sessionStorage",)),
        (r"""localStorage\["']([^"']+)["']""", "high", ("localStorage",)),
        (r"""sessionStorage\["']([^"']+)["']""", "high", ("sessionStorage",)),
    ],
    "cookies": [
        (r"""document\.cookie\s*=?\s*["']?([^"';\n]+)""", "medium", ("document.cookie",)),
        (r"""Cookies\.(?:get|set|remove)\s*\(\s*["']([^"']+)["']""", "high", ("Cookies.",)),
        (r"""jscookie|cookie-parser|universal-cookie""", "low", ("jscookie", "cookie-parser", "universal-cookie")),
        (r"""(?:set|get)Cookie\s*\(\s*["']([^"']+)["']""", "high", ("Cookie",)),
    ],
    "headers": [
        (r"""(?:headers|Headers)\s*[:=]\s*\{([^}]+)\}""", "high", ("eaders",)),
        (r"""\.setHeader\s*\(\s*["']([^"']+)["']""", "high", (".setHeader",)),
        (r"""["'](?:Authorization|Content-Type|X-[^"']+)["']""", "high", ("Authorization", "Content-Type", "X-")),
        (r"""(?:Authorization|Content-Type|Accept|x-[^:]+):\s*["']([^"']+)["']""", "high", ("Authorization", "Content-Type", "Accept", "x-")),
    ],
    "regex_patterns": [
        (r"""/([^/\\]|\\.)+/[gimsuy]*""", "high", ("/",)),
        (r"""new\s+RegExp\s*\(\s*["']([^"']+)["']""", "high", ("RegExp",)),
    ],
    "error_messages": [
        (r"""(?:throw\s+(?:new\s+)?(?:Error|TypeError|RangeError|ReferenceError|SyntaxError))\s*\(\s*["']([^"']+)["']""", "high", ("throw",)),
        (r"""console\.(?:error|warn)\s*\(\s*["']([^"']+)["']""", "high", ("console.",)),
        (r"""(?:reject|Error)\s*\(\s*["']([^"']+)["']""", "high", ("reject", "Error")),
    ],
    "debug_info": [
        (r"""console\.(?:log|debug|info|trace|table|dir|time|timeEnd)\s*\(""", "medium", ("console.",)),
        (r"""debugger""", "high", ("debugger",)),
        (r"""//\s*(?:TODO|FIXME|HACK|XXX|BUG|NOTE)""", "medium", ("//",)),
        (r"""/\*\s*(?:TODO|FIXME|HACK|XXX|BUG|NOTE)""", "medium", ("/*",)),
        (r"""__DEBUG__|__DEV__|development|staging""", "low", ("__DEBUG__", "__DEV__", "development", "staging")),
    ],
    "emails": [
        (r"""[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}""", "medium", ("@",)),
    ],
    "ip_addresses": [
        (r"""\b(?:\d{1,3}\.){3}\d{1,3}\b""", "medium", (".",)),
        (r"""\b(?:[a-fA-F0-9]{1,4}:){7}[a-fA-F0-9]{1,4}\b""", "low", (":",)),
    ],
    "db_connections": [
        (r"""(?:mongodb(?:\+srv)?|postgres(?:ql)?|mysql|redis)://[^\s"'<>]+""", "critical", ("://",)),
        (r"""(?:DB_HOST|DATABASE_URL|CONNECTION_STRING)\s*[:=]\s*["']([^"']+)["']""", "critical", ("DB_HOST", "DATABASE_URL", "CONNECTION_STRING")),
    ],
    "env_vars": [
        (r"""process\.env\.([A-Z_][A-Z0-9_]*)""", "high", ("process.env.",)),
        (r"""import\.meta\.env\.([A-Z_][A-Z0-9_]*)""", "high", ("import.meta.env.",)),
        (r"""REACT_APP_[A-Z0-9_]+""", "medium", ("REACT_APP_",)),
        (r"""NEXT_PUBLIC_[A-Z0-9_]+""", "medium", ("NEXT_PUBLIC_",)),
    ],
    "graphql": [
        (r"""(?:query|mutation|subscription)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*[\({]""", "high", ("query", "mutation", "subscription")),
        (r"""gql`([^`]+)`""", "high", ("gql`",)),
        (r"""graphql\(["']([^"']+)["']""", "medium", ("graphql(",)),
    ],
    "service_keys": [
        (r"""SG\.[a-zA-Z0-9_\-]{22}\.[a-zA-Z0-9_\-]{43}""", "critical", ("SG.",)),
        (r"""AC[a-z0-9]{32}""", "critical", ("AC",)),
        (r"""SK[a-z0-9]{32}""", "critical", ("SK",)),
        (r"""https://hooks\.slack\.com/services/[a-zA-Z0-9/]+""", "critical", ("https://hooks.slack.com/services/",)),
        (r"""AIza[0-9A-Za-z_\-]{35}""", "critical", ("AIza",)),
        (r"""ya29\.[0-9A-Za-z_\-]+""", "high", ("ya29.",)),
        (r"""EAACEdEose0cBA[0-9A-Za-z]+""", "critical", ("EAACEdEose0cBA",)),
        (r"""npm_[a-zA-Z0-9]{36}""", "critical", ("npm_",)),
    ],
    "base64_blobs": [
        (r"""["']([A-Za-z0-9+/]{40,}={0,2})["']""", "low", _QUOTES),
    ],
    "cors_config": [
        (r"""Access-Control-Allow-Origin["']?\s*[:=]\s*["']([^"']+)["']""", "medium", ("Access-Control-Allow-Origin",)),
        (r"""cors\s*\(\s*\{([^}]+)\}""", "medium", ("cors",)),
    ],
    "version_info": [
        (r"""@version\s+([0-9]+\.[0-9]+\.[0-9]+)""", "low", ("@version",)),
        (r"""(?:deprecated|@deprecated)[^\n]*""", "low", ("deprecated",)),
    ],
}

# Equivalent spellings for the JVM, by (category, position): runs that a plain
# search would rescan from every start are entered only where a run can begin,
# and a group repeated per character becomes a possessive, non-recursive loop.
_JAVA = {
    ("emails", 0): r"""(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}""",
    ("regex_patterns", 0): r"""/(?:(?:[^/\\]|\\.)(?!/))*+([^/\\]|\\.)/[gimsuy]*""",
}

# Stretches of a line in which no match can begin once the expression has failed at their start.
_IDLE = {
    ("parameters", 3): r"""(?:params|query|body|data|options|config|args)\s*[:=]\s*\{[^}]*+\z""",
}

# What ends a match and what follows it, for expressions whose unfinished openers tell nothing of the next ones; and the
# expression for their matches without that end.
_CLOSER = {
    ("parameters", 0): (")", "", "(?!)()"),
    ("parameters", 1): (")", r"""\s*=>""", "(?!)()"),
    ("function_names", 2): (")", r"""\s*=>""", r"""(?:const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*=\s*(?:async\s+)?function"""),
}

# The intended reading of expressions that, as specified, miss what they are for.
_CORRECTED = {
    ("function_names", 3): (r"""["']([a-zA-Z_$][a-zA-Z0-9_$]*)["']\s*:\s*(?:async\s+)?function""", ("function",)),
    ("regex_patterns", 0): (r"""/((?:[^/\\]|\\.)+)/[gimsuy]*""", ("/",)),
    ("local_storage_keys", 2): (r"""localStorage\[["']([^"']+)["']\]""", ("localStorage",)),
    ("local_storage_keys", 3): (r"""sessionStorage\[["']([^"']+)["']\]""", ("sessionStorage",)),
}
_CORRECTED_JAVA = {("regex_patterns", 0): r"""/((?:[^/\\]|\\.)++)/[gimsuy]*"""}

WHOLE_TEXT = ("comments",)
CATEGORIES: list[str] = list(_SPEC)
LINE_CATEGORIES: list[str] = [c for c in CATEGORIES if c not in WHOLE_TEXT]


def detectors(category: str, corrected: bool = False) -> list[tuple[Rx, str]]:
    """(expression, confidence) of one category, in evaluation order."""
    out = []
    for k, (pattern, confidence, needs) in enumerate(_SPEC[category]):
        java = _JAVA.get((category, k))
        if corrected and (category, k) in _CORRECTED:
            (pattern, needs), java = _CORRECTED[category, k], _CORRECTED_JAVA.get((category, k))
        out.append((Rx(pattern, needs, "i" if category == "secrets" else "s", java, idle=_IDLE.get((category, k)), closer=_CLOSER.get((category, k))), confidence))
    return out
