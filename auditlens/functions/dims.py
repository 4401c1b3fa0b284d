"""Small, fixed dimension tables.

Everything in the FIXED VALUES block below must equal the audited tool's own
values for results to agree (type → CWE, severity scores, price list, path
exclusions, README candidates, endpoint patterns).  They are data, not code:
each becomes a tiny DataFrame (bounded, a few hundred rows at most) that is
broadcast into joins, so extending a table never needs a code change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the audited tool; natural order kept)
# ---------------------------------------------------------------------------

# Vulnerability type → CWE id, and CWE id → name.
VULN_CWE = [
    ("LFI", "CWE-22"),
    ("RCE", "CWE-78"),
    ("SSRF", "CWE-918"),
    ("AFO", "CWE-73"),
    ("SQLI", "CWE-89"),
    ("XSS", "CWE-79"),
    ("IDOR", "CWE-639"),
]
CWE_NAMES = [
    ("CWE-22", "Path Traversal"),
    ("CWE-78", "OS Command Injection"),
    ("CWE-918", "Server-Side Request Forgery"),
    ("CWE-73", "External Control of File Name or Path"),
    ("CWE-89", "SQL Injection"),
    ("CWE-79", "Cross-site Scripting"),
    ("CWE-639", "Authorization Bypass Through User-Controlled Key"),
]
UNKNOWN_CWE = "CWE-0"
UNKNOWN_CWE_NAME = "Unknown"

# Severity name, score (for sorting), rank (INFO lowest .. CRITICAL highest).
SEVERITIES = [
    ("CRITICAL", 10, 4),
    ("HIGH", 8, 3),
    ("MEDIUM", 5, 2),
    ("LOW", 3, 1),
    ("INFO", 1, 0),
]
# Confidence → severity thresholds: >= 9 CRITICAL, >= 7 HIGH, >= 5 MEDIUM, >= 3 LOW, else INFO.
SEVERITY_THRESHOLDS = [(9, "CRITICAL"), (7, "HIGH"), (5, "MEDIUM"), (3, "LOW")]
# Confidence buckets for the summary: >= 8 high, >= 5 medium, else low.
CONFIDENCE_BUCKETS = [(8, "high"), (5, "medium")]

# Price list in USD per 1 000 tokens (input, output), in table order.
PRICING = [
    ("claude-3-5-sonnet-20241022", 0.003, 0.015),
    ("claude-3-5-sonnet-latest", 0.003, 0.015),
    ("claude-sonnet-4-5", 0.003, 0.015),
    ("claude-sonnet-4-20250514", 0.003, 0.015),
    ("claude-3-opus-20240229", 0.015, 0.075),
    ("claude-3-haiku-20240307", 0.00025, 0.00125),
    ("gpt-4o", 0.005, 0.015),
    ("gpt-4o-2024-08-06", 0.005, 0.015),
    ("chatgpt-4o-latest", 0.005, 0.015),
    ("gpt-4-turbo", 0.01, 0.03),
    ("gpt-4-turbo-preview", 0.01, 0.03),
    ("gpt-3.5-turbo", 0.0005, 0.0015),
    ("ollama", 0.0, 0.0),
    ("llama3", 0.0, 0.0),
    ("codellama", 0.0, 0.0),
    ("mistral", 0.0, 0.0),
]
DEFAULT_PRICE = (0.01, 0.03)
# Provider fallbacks when neither an exact nor a partial name matches:
# (substring of the lower-cased model, entry whose price applies).
PRICE_FALLBACKS = [
    ("claude", "claude-3-5-sonnet-20241022"),
    ("gpt-4o", "gpt-4o"),
    ("gpt-4", "gpt-4-turbo"),
    ("gpt-3", "gpt-3.5-turbo"),
]

# Planning-model constants for dry-run estimates.
EST_PROMPT_OVERHEAD = 3000
EST_CONTEXT_PER_ITERATION = 1000
EST_INITIAL_OUTPUT = 2000
EST_TYPES_PER_FILE = 2.5
EST_ITERATIONS_PER_TYPE = 5
EST_SECONDARY_OUTPUT = 2500
EST_README_OVERHEAD_USD = 0.01

# Path exclusions: substrings of the lower-cased "/relative/path", and
# case-sensitive file-name substrings.
EXCLUDE_PATHS = [
    "/setup.py", "/test", "/example", "/docs", "/site-packages", ".venv",
    "virtualenv", "/dist", "/node_modules", "/__pycache__", "/.git",
]
EXCLUDE_NAMES = ["test_", "conftest", "_test.py"]

# README candidates in priority order.
README_CANDIDATES = ["README.md", "readme.md", "README.rst", "README.txt", "README"]

# The assistant-prefill used for one provider's JSON replies.
PREFILL = '{"scratchpad": "1.'

# Endpoint / sink patterns (Java regex syntax), grouped by framework family,
# in table order.  A file is kept if any of them matches.
NETWORK_PATTERNS = [
    ("Flask", r"app\.route\s*\("),
    ("Flask", r"app\.add_url_rule\s*\("),
    ("Flask", r"Blueprint\s*\("),
    ("Flask", r"@.*\.route\s*\("),
    ("Flask", r"flask\.make_response"),
    ("Flask", r"flask\.send_file"),
    ("Flask", r"flask\.send_from_directory"),
    ("FastAPI", r"app\.(get|post|put|delete|patch|options|head)\s*\("),
    ("FastAPI", r"@.*\.(get|post|put|delete|patch|options|head)\s*\("),
    ("FastAPI", r"APIRouter\s*\("),
    ("FastAPI", r"FastAPI\s*\("),
    ("FastAPI", r"Depends\s*\("),
    ("FastAPI", r"BackgroundTasks"),
    ("Django", r"path\s*\(\s*['\"].*['\"]\s*,"),
    ("Django", r"re_path\s*\("),
    ("Django", r"url\s*\(\s*r?['\"].*['\"]\s*,"),
    ("Django", r"urlpatterns\s*="),
    ("Django", r"class\s+\w+.*View\s*[:(]"),
    ("Django", r"class\s+\w+.*APIView\s*[:(]"),
    ("Django", r"class\s+\w+.*ViewSet\s*[:(]"),
    ("Django", r"class\s+\w+.*Serializer\s*[:(]"),
    ("Django", r"class\s+\w+.*Mixin\s*[:(]"),
    ("Django", r"class\s+\w+.*Middleware\s*[:(]"),
    ("Django", r"def\s+(get|post|put|patch|delete|dispatch)\s*\(self"),
    ("Django", r"HttpResponse\s*\("),
    ("Django", r"JsonResponse\s*\("),
    ("Django", r"FileResponse\s*\("),
    ("Django", r"StreamingHttpResponse"),
    ("Tornado", r"class\s+\w+.*RequestHandler\s*[:(]"),
    ("Tornado", r"class\s+\w+.*WebSocketHandler\s*[:(]"),
    ("Tornado", r"tornado\.web\.Application\s*\("),
    ("Tornado", r"tornado\.ioloop"),
    ("aiohttp", r"app\.router\.add_(get|post|put|delete|patch|route)\s*\("),
    ("aiohttp", r"web\.(get|post|put|delete|patch|route)\s*\("),
    ("aiohttp", r"aiohttp\.web\.Application"),
    ("aiohttp", r"aiohttp\.ClientSession"),
    ("Sanic", r"app\.(get|post|put|delete|patch)\s*\("),
    ("Sanic", r"@app\.(get|post|put|delete|patch)\s*\("),
    ("Sanic", r"sanic\.Sanic"),
    ("Falcon", r"class\s+\w+.*Resource\s*[:(]"),
    ("Falcon", r"app\.add_route\s*\("),
    ("Falcon", r"falcon\.App\s*\("),
    ("Falcon", r"falcon\.API\s*\("),
    ("CherryPy", r"@cherrypy\.expose"),
    ("CherryPy", r"cherrypy\.quickstart\s*\("),
    ("CherryPy", r"cherrypy\.tree\.mount"),
    ("Starlette", r"Route\s*\(\s*['\"].*['\"]\s*,"),
    ("Starlette", r"Mount\s*\(\s*['\"].*['\"]\s*,"),
    ("Starlette", r"Starlette\s*\("),
    ("Starlette", r"WebSocketRoute\s*\("),
    ("Pyramid", r"config\.add_route\s*\("),
    ("Pyramid", r"config\.add_view\s*\("),
    ("Pyramid", r"@view_config"),
    ("Pyramid", r"@view_defaults"),
    ("Pyramid", r"Configurator\s*\("),
    ("Bottle", r"bottle\.route\s*\("),
    ("Bottle", r"bottle\.get\s*\("),
    ("Bottle", r"bottle\.post\s*\("),
    ("Bottle", r"@bottle\.(route|get|post|put|delete)"),
    ("Bottle", r"bottle\.run\s*\("),
    ("Quart", r"quart\.Quart\s*\("),
    ("Quart", r"@app\.before_request"),
    ("Quart", r"@app\.after_request"),
    ("web2py", r"def\s+(index|create|update|delete|show)\s*\(\)"),
    ("web2py", r"response\.render"),
    ("web2py", r"request\.vars"),
    ("Hug", r"hug\.(get|post|put|delete|call)\s*\("),
    ("Hug", r"@hug\."),
    ("Dash", r"dash\.Dash\s*\("),
    ("Dash", r"@app\.callback"),
    ("Dash", r"dash_core_components"),
    ("Responder", r"responder\.API\s*\("),
    ("Gradio", r"gr\.Interface\s*\("),
    ("Gradio", r"gr\.Blocks\s*\("),
    ("Gradio", r"\.launch\s*\("),
    ("GraphQL", r"graphene\.(ObjectType|Mutation|Schema)"),
    ("GraphQL", r"strawberry\.(type|mutation|schema)"),
    ("GraphQL", r"ariadne\."),
    ("AWS Lambda", r"def\s+lambda_handler\s*\("),
    ("AWS Lambda", r"def\s+handler\s*\(event"),
    ("Azure Functions", r"def\s+main\s*\(req:\s*func\.HttpRequest"),
    ("Azure Functions", r"@app\.function_name"),
    ("GCP Functions", r"def\s+\w+\(request\)"),
    ("GCP Functions", r"functions_framework"),
    ("Server startup", r"uvicorn\.run\s*\("),
    ("Server startup", r"gunicorn"),
    ("Server startup", r"waitress\.serve\s*\("),
    ("Server startup", r"app\.run\s*\("),
    ("Server startup", r"hypercorn\.run"),
    ("Server startup", r"daphne"),
    ("Server startup", r"twisted\.web"),
    ("Server startup", r"http\.server\.HTTPServer"),
    ("Server startup", r"socketserver\.(TCPServer|ThreadingTCPServer)"),
    ("WebSocket", r"(?i)websocket"),
    ("WebSocket", r"@.*\.ws\s*\("),
    ("WebSocket", r"WebSocket\s*\("),
    ("WebSocket", r"channels\.routing"),
    ("WebSocket", r"channels\.consumer"),
    ("gRPC", r"(?i)servicer"),
    ("gRPC", r"add_.*_to_server"),
    ("gRPC", r"grpc\.server"),
    ("HTTP clients", r"requests\.(get|post|put|delete|patch|head|options)\s*\("),
    ("HTTP clients", r"urllib\.request\.urlopen"),
    ("HTTP clients", r"urllib3"),
    ("HTTP clients", r"httpx\.(get|post|put|delete|AsyncClient|Client)"),
    ("HTTP clients", r"aiohttp\.ClientSession"),
    ("Async handlers", r"async\s+def\s+(get|post|put|delete|patch|dispatch|handle|websocket_connect)\s*\("),
    ("XML parsing", r"xml\.etree\.ElementTree"),
    ("XML parsing", r"lxml\.etree"),
    ("XML parsing", r"xml\.sax"),
    ("XML parsing", r"defusedxml"),
    ("File handling", r"send_file\s*\("),
    ("File handling", r"open\s*\(.*request"),
    ("File handling", r"shutil\.(copy|move|rmtree)"),
    ("File handling", r"os\.path\.join\s*\(.*request"),
    ("File handling", r"pathlib\.Path.*request"),
    ("Database", r"cursor\.execute\s*\("),
    ("Database", r"\.raw\s*\("),
    ("Database", r"\.extra\s*\("),
    ("Database", r"sqlalchemy\.text\s*\("),
    ("Database", r"engine\.execute"),
    ("Templates", r"render_template_string\s*\("),
    ("Templates", r"Markup\s*\("),
    ("Templates", r"\|safe\b"),
    ("Templates", r"mark_safe\s*\("),
    ("Templates", r"autoescape\s*=\s*False"),
]

# Stand-in texts for missing or unusable input.
NO_README = "No README available."
README_FAILED = "README summarization failed."
PARSE_FAILED = "Failed to parse structured response"

# ---------------------------------------------------------------------------
# Own tables (this engine's wording and choices, not the audited tool's)
# ---------------------------------------------------------------------------

TOOL_NAME = "auditlens"
TOOL_VERSION = "0.1.0"
RULE_PREFIX = "auditlens"

# Deterministic sink rules per vulnerability type (Java regex).  Used by the
# built-in scorer; a hit count per (file, type) yields a confidence.
SINK_RULES = [
    ("LFI", r"\bopen\s*\("),
    ("LFI", r"\bio\.open\s*\("),
    ("LFI", r"send_file\s*\("),
    ("LFI", r"os\.path\.join\s*\("),
    ("RCE", r"\beval\s*\("),
    ("RCE", r"\bexec\s*\("),
    ("RCE", r"subprocess\.\w+\s*\("),
    ("RCE", r"os\.(system|popen)\s*\("),
    ("RCE", r"pickle\.loads?\s*\("),
    ("RCE", r"yaml\.load\s*\("),
    ("SSRF", r"requests\.(get|post|put|delete|patch|head|request)\s*\("),
    ("SSRF", r"urllib\.request\.urlopen\s*\("),
    ("SSRF", r"httpx\.\w+\s*\("),
    ("SSRF", r"aiohttp\.ClientSession"),
    ("AFO", r"open\s*\([^)]*['\"][wa]b?\+?['\"]"),
    ("AFO", r"shutil\.(copy\w*|move)\s*\("),
    ("AFO", r"\.save\s*\("),
    ("AFO", r"os\.(rename|replace|remove)\s*\("),
    ("SQLI", r"cursor\.execute\s*\("),
    ("SQLI", r"engine\.execute\s*\("),
    ("SQLI", r"\.raw\s*\("),
    ("SQLI", r"sqlalchemy\.text\s*\("),
    ("XSS", r"render_template_string\s*\("),
    ("XSS", r"Markup\s*\("),
    ("XSS", r"mark_safe\s*\("),
    ("XSS", r"\|safe\b"),
    ("IDOR", r"\.objects\.get\s*\("),
    ("IDOR", r"\.query\.get\s*\("),
    ("IDOR", r"request\.(args|GET|view_args)\[?"),
]

# Own prompt wording: instructions per type and example inputs.
PROMPT_TYPES = [
    ("LFI", "Trace remote input into file reads (open, io.open, os.path.join) and report local file inclusion.",
     ["../../etc/hosts", "....//....//etc/hosts", "%2e%2e%2fetc%2fhosts"]),
    ("RCE", "Trace remote input into code or command execution (eval, exec, subprocess, os.system, unsafe deserialisation).",
     ["; id", "$(id)", "__import__('os').getcwd()"]),
    ("SSRF", "Trace remote input into outbound requests (requests, urllib, httpx) and report server-side request forgery.",
     ["http://127.0.0.1:8080/", "http://[::1]/", "file:///etc/hosts"]),
    ("AFO", "Trace remote input into file writes, moves or deletes and report arbitrary file overwrite.",
     ["../../tmp/x", "name.txt%00.png"]),
    ("SQLI", "Trace remote input into SQL text (cursor.execute, raw, text) and report SQL injection.",
     ["' OR 'a'='a", "1 UNION SELECT 1--"]),
    ("XSS", "Trace remote input into rendered markup (render_template_string, Markup, |safe) and report cross-site scripting.",
     ["<img src=x onerror=alert(1)>", "{{7*7}}"]),
    ("IDOR", "Trace remote identifiers into object lookups without an ownership check and report insecure direct object references.",
     []),
]
INITIAL_INSTRUCTIONS = ("List the remote entry points of the file, the sinks they reach and the "
                        "names of any functions or classes you need to see.")
ANALYSIS_APPROACH = "Follow each input from entry point to sink; note sanitisers on the way."
GUIDELINES = "Report only remotely reachable issues; give a confidence from 0 to 10."
RESPONSE_FORMAT = ('{"scratchpad": str, "analysis": str, "poc": str|null, "confidence_score": number, '
                   '"vulnerability_types": [LFI|RCE|SSRF|AFO|SQLI|XSS|IDOR], '
                   '"context_code": [{"name": str, "reason": str, "code_line": str}]}')
README_INSTRUCTIONS = "Summarise what this project does and how it is reached over the network, inside <summary></summary>."
SYSTEM_INSTRUCTIONS = "You audit Python source for remotely exploitable vulnerabilities."


# ---------------------------------------------------------------------------
# DataFrame builders (all tiny; callers hint broadcast)
# ---------------------------------------------------------------------------

def local_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small fixed table as a JVM-local relation (no Python worker to scan it).

    Built with ``inline`` over an array of struct literals, so it plans as a
    local scan that Catalyst can size exactly and broadcast for free.
    """
    from pyspark.sql.types import _parse_datatype_string

    st = _parse_datatype_string(schema)
    names = [f.name for f in st.fields]
    if not rows:
        return spark.createDataFrame([], st)
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(n) for v, n, f in zip(r, names, st.fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def rule_dim(spark: SparkSession) -> DataFrame:
    """vuln_type, cwe, cwe_name, type_ord (table order)."""
    names = dict(CWE_NAMES)
    rows = [(t, c, names[c], i) for i, (t, c) in enumerate(VULN_CWE)]
    return local_table(spark, rows, "vuln_type string, cwe string, cwe_name string, type_ord int")


def severity_dim(spark: SparkSession) -> DataFrame:
    rows = [(s, sc, r, i) for i, (s, sc, r) in enumerate(SEVERITIES)]
    return local_table(spark, rows, "severity string, sev_score int, sev_rank int, sev_ord int")


def pricing_dim(spark: SparkSession) -> DataFrame:
    """ord, model, in_nano, out_nano: nano-USD per token (exact integers)."""
    rows = [(i, m, int(round(pi * 1e6)), int(round(po * 1e6))) for i, (m, pi, po) in enumerate(PRICING)]
    return local_table(spark, rows, "ord int, model string, in_nano long, out_nano long")


def pattern_dim(spark: SparkSession, patterns=None) -> DataFrame:
    rows = [(i, fam, pat) for i, (fam, pat) in enumerate(patterns or NETWORK_PATTERNS)]
    return local_table(spark, rows, "pat_ord int, family string, pattern string")


def sink_dim(spark: SparkSession) -> DataFrame:
    rows = [(i, t, p) for i, (t, p) in enumerate(SINK_RULES)]
    return local_table(spark, rows, "rule_ord int, vuln_type string, pattern string")


def prompt_dim(spark: SparkSession) -> DataFrame:
    rows = [(t, txt, list(b), i) for i, (t, txt, b) in enumerate(PROMPT_TYPES)]
    return local_table(spark, rows, "vuln_type string, template string, bypasses array<string>, type_ord int")


def readme_dim(spark: SparkSession) -> DataFrame:
    rows = [(n, i) for i, n in enumerate(README_CANDIDATES)]
    return local_table(spark, rows, "name string, prio int")


def cwe_of(type_col) -> "F.Column":
    """Vulnerability type → CWE id (unknown → CWE-0), as a CASE."""
    expr = F.lit(UNKNOWN_CWE)
    for t, c in reversed(VULN_CWE):
        expr = F.when(type_col == t, F.lit(c)).otherwise(expr)
    return expr


def cwe_name_of(type_col) -> "F.Column":
    names = dict(CWE_NAMES)
    expr = F.lit(UNKNOWN_CWE_NAME)
    for t, c in reversed(VULN_CWE):
        expr = F.when(type_col == t, F.lit(names[c])).otherwise(expr)
    return expr


def severity_of(conf_col) -> "F.Column":
    """Confidence → severity name."""
    expr = F.lit("INFO")
    for thr, name in reversed(SEVERITY_THRESHOLDS):
        expr = F.when(conf_col >= thr, F.lit(name)).otherwise(expr)
    return expr


def confidence_bucket(conf_col) -> "F.Column":
    expr = F.lit("low")
    for thr, name in reversed(CONFIDENCE_BUCKETS):
        expr = F.when(conf_col >= thr, F.lit(name)).otherwise(expr)
    return expr


def severity_score(sev_col) -> "F.Column":
    """Severity name → score (unknown → 0), as a CASE (no join needed)."""
    expr = F.lit(0)
    for s, sc, _ in SEVERITIES:
        expr = F.when(sev_col == s, F.lit(sc)).otherwise(expr)
    return expr


def severity_rank(sev_col) -> "F.Column":
    """Severity name → rank INFO=0 .. CRITICAL=4, unknown → -1."""
    expr = F.lit(-1)
    for s, _, r in SEVERITIES:
        expr = F.when(sev_col == s, F.lit(r)).otherwise(expr)
    return expr


def rank_of_name(name) -> int:
    for s, _, r in SEVERITIES:
        if s == name:
            return r
    return -1
