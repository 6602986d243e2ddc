"""How twenty families of languages write comments and strings."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pagesieve.functions.regex import Rx


@dataclass(frozen=True)
class Language:
    key: str
    name: str
    extensions: tuple[str, ...]
    filenames: tuple[str, ...]
    line: tuple[str, ...]
    block: tuple[tuple[str, str], ...]
    strings: tuple[str, ...]
    escape: str


_C = (("/*", "*/"),)
_BOTH = ('"', "'")
_B = "\\"

# Names, file types, comment markers, string delimiters, escapes.
LANGUAGES: list[Language] = [
    Language("web_markup", "HTML / XML", (".html", ".htm", ".xml", ".xhtml", ".vue", ".svg"), (), (), (("<!--", "-->"),), _BOTH, _B),
    Language("css", "CSS / SCSS / LESS", (".css", ".scss", ".sass", ".less"), (), ("//",), _C, _BOTH, _B),
    Language("javascript", "JavaScript / TypeScript", (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".cts"), (), ("//",), _C, ('"', "'", "`"), _B),
    Language("php", "PHP", (".php", ".phtml", ".php3", ".php4", ".php5"), (), ("//", "#"), _C, _BOTH, _B),
    Language("python", "Python", (".py", ".pyw", ".pyi"), (), ("#",), (), ('"""', "'''", '"', "'"), _B),
    Language("c_family", "C / C++ / Java / C# / Go / Rust / Swift / Kotlin", (".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".java", ".cs", ".go", ".rs", ".swift", ".kt", ".kts"), (), ("//",), _C, _BOTH, _B),
    Language("ruby", "Ruby", (".rb", ".rbw"), (), ("#",), (("=begin", "=end"),), ('"', "'", "`"), _B),
    Language("shell", "Shell / Bash / Zsh", (".sh", ".bash", ".zsh", ".ksh", ".fish"), (), ("#",), (), ('"', "'", "`"), _B),
    Language("sql", "SQL", (".sql",), (), ("--",), _C, _BOTH, _B),
    Language("config", "YAML / INI / TOML / Config", (".yaml", ".yml", ".ini", ".cfg", ".conf", ".toml", ".properties"), (), ("#", ";"), (), _BOTH, _B),
    Language("jsonc", "JSONC / JSON5", (".jsonc", ".json5"), (), ("//",), _C, _BOTH, _B),
    Language("dockerfile", "Dockerfile / Makefile", (".dockerfile", ".mk"), ("Dockerfile", "Makefile", "makefile", "GNUmakefile"), ("#",), (), _BOTH, _B),
    Language("vim", "Vim Script", (".vim",), (".vimrc", "_vimrc"), ('"',), (), ("'",), _B),
    Language("lua", "Lua", (".lua",), (), ("--",), (("--[[", "]]"),), _BOTH, _B),
    Language("haskell", "Haskell", (".hs", ".lhs"), (), ("--",), (("{-", "-}"),), _BOTH, _B),
    Language("lisp", "Lisp / Clojure / Scheme", (".lisp", ".clj", ".cljs", ".cljc", ".scm", ".rkt"), (), (";",), (("#|", "|#"),), ('"',), _B),
    Language("erlang", "Erlang", (".erl", ".hrl"), (), ("%",), (), ('"',), _B),
    Language("fortran", "Fortran", (".f", ".f90", ".f95", ".for", ".f03"), (), ("!",), (), _BOTH, ""),
    Language("powershell", "PowerShell", (".ps1", ".psm1", ".psd1"), (), ("#",), (("<#", "#>"),), _BOTH, "`"),
    Language("batch", "Batch / CMD", (".bat", ".cmd"), (), ("REM", "::"), (), (), ""),
]
BY_KEY = {lang.key: lang for lang in LANGUAGES}

# Folders a comment scan leaves out.
EXCLUDED_DIRS = [
    ".git", ".svn", ".hg", "node_modules", "__pycache__", "venv", "env", ".venv",
    "dist", "build", "target", "out", ".idea", ".vscode",
]


def block_markers(lang: Language) -> list[tuple[str, str]]:
    return sorted(lang.block, key=lambda m: len(m[0]), reverse=True)


def line_markers(lang: Language) -> list[str]:
    return sorted(lang.line, key=len, reverse=True)


def token(lang: Language) -> Rx:
    """Comments and strings of ``lang`` as one alternation over the text.

    Strings are matched only so that markers inside them do not count; a hit is a
    comment when it starts with a comment marker.  Order gives the priority:
    block comments, line comments, strings, each longest first.  An unterminated
    token runs to the end of the text.  Loops are possessive on the JVM, so long
    tokens neither recurse nor backtrack.
    """
    jvm, plain = [], []
    for start, end in block_markers(lang):
        jvm.append(f"{_lit(start)}(?s:.*?)(?:{_lit(end)}|\\z)")
        plain.append(jvm[-1])
    for marker in line_markers(lang):
        # a marker made of word characters may not continue a word
        guard = r"(?<![\p{L}\p{N}_])" if re.fullmatch(r"\w+", marker) else ""
        jvm.append(f"{guard}{_lit(marker)}[^\\n]*+\\n?")
        plain.append(f"{_lit(marker)}[^\\n]*\\n?")
    for delimiter in sorted(lang.strings, key=len, reverse=True):
        jvm.append(_string(delimiter, lang.escape))
        plain.append(_plain_string(delimiter, lang.escape))
    openers = [start for start, _ in block_markers(lang)] + line_markers(lang)
    return Rx("|".join(plain), tuple(openers), "", "|".join(jvm))


def _lit(text: str) -> str:
    return re.escape(text)


def _string(delimiter: str, escape: str) -> str:
    """A string for the JVM: possessive, so it neither recurses nor backtracks."""
    d, c, e = _lit(delimiter), _lit(delimiter[0]), _lit(escape)
    parts = [f"[^{c}{e}]++"]
    if len(delimiter) > 1:
        parts.append(f"{c}(?!{_lit(delimiter[1:])})")
    if escape:
        parts.append(f"(?s:{e}.)")
    end = f"{e}?\\z" if escape else "\\z"
    return f"{d}(?:{'|'.join(parts)})*+(?:{d}|{end})"


def _plain_string(delimiter: str, escape: str) -> str:
    """The same, as the shortest run of characters and escapes up to the delimiter."""
    d, e = _lit(delimiter), _lit(escape)
    if not escape:
        return f"{d}(?s:.*?)(?:{d}|\\z)"
    return f"{d}(?s:(?:[^{e}]|{e}.)*?)(?:{d}|{e}?\\z)"
