"""Endpoint detectors: what is searched in scripts, and what is not an endpoint."""

from pagesieve.functions.regex import Rx

# The ten expressions and their type names, in evaluation order.
# All ignore case; `needs` are substrings every match contains.
ENDPOINT_TYPES: list[tuple[str, Rx]] = [
    ("absolute_url", Rx(r"""https?://[^\s"'<>{}\[\]\\]+""", ("://",), "i")),
    ("relative_path", Rx(r"""["']([/][^\s"'<>{}\[\]\\]*(?:\.[a-zA-Z]{2,})?)["']""", ("'/", '"/'), "i")),
    ("template_literal", Rx(r"""`([^`]*?/[^`]*)`""", ("`",), "i")),
    ("assigned_path", Rx(r"""(?:url|path|endpoint|route|api)[\s]*[:=][\s]*["']([^"']+)["']""",
                         ("url", "path", "endpoint", "route", "api"), "i")),
    ("ajax_call", Rx(r"""(?:fetch|ajax|axios|\.get|\.post|\.put|\.delete|\.patch)\s*\(\s*["']([^"']+)["']""",
                     ("fetch", "ajax", "axios", ".get", ".post", ".put", ".delete", ".patch"), "i")),
    ("import_path", Rx(r"""(?:import|require)\s*\(?["']([^"']+)["']""", ("import", "require"), "i")),
    ("location_assign", Rx(r"""(?:window\.location|location\.href)\s*=\s*["']([^"']+)["']""",
                           ("window.location", "location.href"), "i")),
    ("base_url", Rx(r"""(?:baseURL|BASE_URL|API_URL|apiUrl|baseUrl)[\s]*[:=][\s]*["']([^"']+)["']""",
                    ("baseurl", "base_url", "api_url", "apiurl"), "i")),
    ("graphql", Rx(r"""(?:graphql|gql)[\s]*[`"']([^`"']*)[`"']""", ("graphql", "gql"), "i")),
    ("websocket", Rx(r"""(?:ws|wss)://[^\s"'<>{}\[\]\\]+""", ("ws://", "wss://"), "i")),
]

# What is never an endpoint, tested at the start of the trimmed value.
REJECT_AT_START = [
    r"^javascript:",
    r"^data:",
    r"^#",
    r"^\s*$",
    r"\.(png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|eot)(\?|$)",
    r"\.(css)(\?|$)",
    r"^\{",
    r"^\}$",
    r"^\[$",
    r"^\]$",
    r"^[a-zA-Z]+:$",
    r"^undefined$",
    r"^null$",
    r"^true$",
    r"^false$",
    r"^\d+$",
]
# Static assets anywhere in the value, for callers who want them dropped.
STATIC_ASSET = r"\.(?:png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|eot|css)(?:\?|$)"

# Fixed value: how a request method shows in the text ahead of an endpoint.
METHOD = r"""(?:(?:fetch|axios|\.request)\s*\(\s*\{[^}]*method\s*:\s*["'](\w+)["']|(\.(get|post|put|delete|patch))\s*\()"""
# How far around a match to look.
METHOD_WINDOW = 200
CONTEXT_WINDOW = 50
