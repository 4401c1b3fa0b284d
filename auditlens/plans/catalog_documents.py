"""Registered queries: whole report documents, line by line, and the written reports.

The SQL builds every line of each document on its own - heads, tables, fragments,
ends - so a document is compared as the text that a reader gets, not by parts
of it.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from auditlens.functions import dims
from auditlens.operators import reports as R
from auditlens.plans import oracle as O
from auditlens.plans.catalog import register
from auditlens.plans.catalog_findings import _all_files, _findings
from auditlens.plans.catalog_ledger import L, _costs
from auditlens.plans.catalog_reports import _CSV_ROW, _EMO, _HTML, _MD, _TS, _URL, FR, RUN_TS, SECRET, _pads, _summary
from auditlens.sources.tables import FX_SQL


def J(x: str) -> str:
    """JSON text of a value."""
    return f"CAST(to_json({x}) AS VARCHAR)"


def obj(*members: tuple[str, str]) -> str:
    """JSON object text; a member whose text is null stays out."""
    cells = [f"'\"{name}\":' || {text}" for name, text in members]
    return "'{' || concat_ws(',', " + ", ".join(cells) + ") || '}'"


def dump(x) -> str:
    return O.q(json.dumps(x, separators=(",", ":"), ensure_ascii=False))


_CWE_PAGE = "https://cwe.mitre.org/data/definitions/{}.html"
_HIGH = str({s: sc for s, sc, _ in dims.SEVERITIES}["HIGH"])
_SARIF_HEAD = {
    "$schema": R.SARIF_SCHEMA, "version": "2.1.0", "runs": [{
        "tool": {"driver": {"name": dims.TOOL_NAME, "version": dims.TOOL_VERSION, "rules": [
            {"id": f"{dims.RULE_PREFIX}/{t}", "name": t, "shortDescription": {"text": f"{t} vulnerability detection"},
             "fullDescription": {"text": dict(dims.CWE_NAMES)[c]}, "helpUri": _CWE_PAGE.format(c[4:]),
             "properties": {"tags": ["security", c], "security-severity": _HIGH}} for t, c in dims.VULN_CWE]}},
        "invocations": [{"executionSuccessful": True, "startTimeUtc": RUN_TS}],
        "taxonomies": [{"name": "CWE", "version": "4.13", "taxa": [
            {"id": c, "name": n, "shortDescription": {"text": n}, "helpUri": _CWE_PAGE.format(c[4:])} for c, n in dims.CWE_NAMES]}],
        "results": []}]}

_SCORE = O.sev_score_case()
_LOC = obj(("artifactLocation", obj(("uri", J("file_path")))),
           ("region", f"CASE WHEN start_line > 0 THEN {obj(('startLine', 'start_line'), ('endLine', 'CASE WHEN end_line <> 0 THEN end_line ELSE start_line END'))} END"))
_FLOW = obj(("location", obj(("physicalLocation", obj(("artifactLocation", obj(("uri", J("file_path")))))),
                             ("message", obj(("text", J("substr(context_code, 1, 500)")))))))
_SARIF = obj(
    ("ruleId", J("rule_id")),
    ("level", "CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN '\"error\"' WHEN severity = 'MEDIUM' THEN '\"warning\"' ELSE '\"note\"' END"),
    ("message", obj(("text", J("analysis")))),
    ("partialFingerprints", obj(("primaryLocationLineHash", J("substr(sha256(file_path || ':' || vuln_type || ':' || substr(analysis, 1, 200)), 1, 16)")))),
    ("locations", f"'[' || {obj(('physicalLocation', _LOC))} || ']'"),
    ("properties", obj(("confidence", "confidence"), ("severity", J("severity")), ("cwe", J("cwe")),
                       ("security-severity", f"'\"' || CASE WHEN {_SCORE} > 0 THEN {_SCORE} ELSE 5 END || '\"'"),
                       ("poc", f"CASE WHEN coalesce(poc, '') <> '' THEN {J('poc')} END"), ("discovered_at", J(_TS)))),
    ("codeFlows", f"CASE WHEN context_code <> '' THEN '[{{\"threadFlows\":[{{\"locations\":[' || {_FLOW} || ']}}]}}]' END"))

_JSON = obj(
    ("rule_id", J("rule_id")), ("title", J("title")), ("file_path", J("file_path")), ("start_line", "start_line"), ("end_line", "end_line"),
    ("vuln_type", J("vuln_type")), ("severity", J("severity")), ("confidence", "confidence"), ("cwe", J("cwe")), ("cwe_name", J("cwe_name")),
    ("cwe_url", J(_URL)), ("analysis", J("analysis")), ("scratchpad", "'\"\"'"), ("poc", f"coalesce({J('poc')}, 'null')"),
    ("context_code", f"CASE WHEN context_code <> '' THEN {J('context_code')} END"), ("discovered_at", f"coalesce({J(_TS)}, 'null')"))

_MAP = lambda k: (f"(SELECT repo_id, string_agg({J('k')} || ':' || n, ',' ORDER BY k) AS m FROM "  # noqa: E731
                  f"(SELECT repo_id, {k} AS k, count(*) AS n FROM fx_findings GROUP BY ALL) GROUP BY repo_id)")
_SEV_ORD = "CASE severity " + " ".join(f"WHEN {O.q(s)} THEN {i}" for i, (s, _, _) in enumerate(dims.SEVERITIES)) + " END"
_SEV_HTML = ("string_agg('<tr><td>' || severity || '</td><td>' || n || '</td></tr>', chr(10) ORDER BY " + _SEV_ORD + ")")

# findings, and per repository: files, findings, maps by type, bucket and severity
SM = FR.rstrip().replace("WITH ", f"WITH fx_files AS ({FX_SQL['fx_files']}),\n", 1) + f""",
af AS (SELECT 'r' || CAST(doc_id % 20 AS STRING) AS repo_id, count(*) AS total_files FROM fx_files GROUP BY 1),
nf AS (SELECT repo_id, count(*) AS n FROM fx_findings GROUP BY 1),
sm AS (SELECT repo_id, coalesce(af.total_files, 0) AS total_files, coalesce(nf.n, 0) AS total_findings,
         coalesce(t.m, '') AS by_type, coalesce(b.m, '') AS by_bucket, coalesce(s.m, '') AS by_sev
       FROM af FULL JOIN nf USING (repo_id) LEFT JOIN {_MAP('vuln_type')} t USING (repo_id)
         LEFT JOIN {_MAP(O.bucket_case())} b USING (repo_id) LEFT JOIN {_MAP('severity')} s USING (repo_id)),
sv AS (SELECT repo_id, severity, count(*) AS n FROM fx_findings GROUP BY ALL),
ty AS (SELECT repo_id, vuln_type, min(finding_ord) AS lo, count(*) AS n FROM fx_findings GROUP BY ALL)
"""


def _line(part: int, text: str, ord_: str = "0") -> str:
    return f"SELECT repo_id, {part} AS part, CAST({ord_} AS BIGINT) AS ord, {text} AS text"


_COMMA = "CASE WHEN pos > 1 THEN ',' ELSE '' END || "
_HEADS = json.dumps(_SARIF_HEAD, separators=(",", ":"), ensure_ascii=False)
DOCUMENTS = {
    "sarif": " UNION ALL ".join([
        _line(0, O.q(_HEADS[:-len("]}]}")])) + " FROM sm", _line(1, _COMMA + _SARIF, "pos") + " FROM fr", _line(2, "']}]}'") + " FROM sm"]),
    "json": " UNION ALL ".join([
        _line(0, "'{\"metadata\":{\"tool\":" + json.dumps(dims.TOOL_NAME) + ",\"version\":" + json.dumps(dims.TOOL_VERSION) + ",\"timestamp\":" + json.dumps(RUN_TS)
              + ",\"files_analyzed\":' || total_files || ',\"total_findings\":' || total_findings || '},\"summary\":{\"total_files\":' || total_files || "
              "',\"total_findings\":' || total_findings || ',\"by_vuln_type\":{' || by_type || '},\"by_confidence\":{' || by_bucket || '},\"by_severity\":{' || by_sev || '}},\"findings\":['")
        + " FROM sm", _line(1, _COMMA + _JSON, "pos") + " FROM fr", _line(2, "']}'") + " FROM sm"]),
    "markdown": " UNION ALL ".join([
        _line(0, f"concat_ws(chr(10), '# {R.REPORT_TITLE}', '', '**Generated**: {RUN_TS}', '**Tool**: {dims.TOOL_NAME} v{dims.TOOL_VERSION}', '', '## Summary', '', "
                 f"'| Metric | Value |', '|--------|-------|', '| {R.FILES_LABEL} | ' || total_files || ' |', '| {R.FINDINGS_LABEL} | ' || total_findings || ' |', '')") + " FROM sm",
        "SELECT DISTINCT repo_id, 1, CAST(0 AS BIGINT), concat_ws(chr(10), '### " + R.BY_SEVERITY + "', '', '| Severity | Count |', '|----------|-------|') FROM sv",
        _line(2, f"'| ' || {_EMO} || ' ' || severity || ' | ' || n || ' |'", _SEV_ORD) + " FROM sv",
        "SELECT DISTINCT repo_id, 3, CAST(0 AS BIGINT), concat_ws(chr(10), '', '### " + R.BY_TYPE + "', '', '| Type | Count | CWE |', '|------|-------|-----|') FROM ty",
        _line(4, "'| ' || vuln_type || ' | ' || n || ' | ' || coalesce(cwe, 'N/A') || ' |'", "lo") + f" FROM ty LEFT JOIN {O.rule_values()} USING (vuln_type)",
        _line(5, "CASE WHEN total_findings > 0 THEN chr(10) || '## Findings' || chr(10) ELSE '## No vulnerabilities found' || chr(10) END") + " FROM sm",
        _line(6, _MD, "pos") + " FROM fr"]),
    "html": " UNION ALL ".join([
        _line(0, f"concat_ws(chr(10), '<!DOCTYPE html>', '<html lang=\"en\">', '<head><meta charset=\"UTF-8\"><title>Vulnerability Report — {dims.TOOL_NAME}</title></head>', '<body>', "
                 f"'<h1>{R.REPORT_TITLE}</h1>', '<p>Generated: {RUN_TS} | Tool: {dims.TOOL_NAME} v{dims.TOOL_VERSION}</p>', '<div class=\"summary\"><h2>Summary</h2><table>', "
                 f"'<tr><td>{R.FILES_LABEL}</td><td>' || total_files || '</td></tr>', '<tr><td>{R.FINDINGS_LABEL}</td><td>' || total_findings || '</td></tr>', '</table>' || "
                 "coalesce(chr(10) || concat_ws(chr(10), '<table>', '<tr><th>Severity</th><th>Findings</th></tr>', h.rows, '</table>'), '') || '</div>', '<h2>Findings</h2>', "
                 "CASE WHEN total_findings = 0 THEN '<p>No vulnerabilities found.</p>' END)")
        + f" FROM sm LEFT JOIN (SELECT repo_id, {_SEV_HTML} AS rows FROM sv GROUP BY repo_id) h USING (repo_id)",
        _line(1, _HTML, "pos") + " FROM fr", _line(2, "concat_ws(chr(10), '</body>', '</html>')") + " FROM sm"]),
    "csv": " UNION ALL ".join([
        _line(0, O.q(",".join(R.CSV_HEADER))) + " FROM sm", _line(1, f"concat({_CSV_ROW})", "pos") + " FROM fr"]),
}


def _register(name: str, make) -> None:
    register(f"{name}_document", SM + "SELECT * FROM (" + DOCUMENTS[name] + ")")(make)


def _maps(spark, sf):
    from auditlens.operators.findings import scan_summary
    return scan_summary(_findings(spark, sf), _all_files(spark, sf), as_text=False)


_register("sarif", lambda spark, sf: R.sarif_report(_findings(spark, sf), RUN_TS, _maps(spark, sf)))
_register("json", lambda spark, sf: R.json_report(_findings(spark, sf), _maps(spark, sf), RUN_TS))
_register("markdown", lambda spark, sf: R.markdown_report(_findings(spark, sf), _maps(spark, sf), RUN_TS))
_register("html", lambda spark, sf: R.html_report(_findings(spark, sf), _maps(spark, sf), RUN_TS))


# ---------------------------------------------------------------------------
# Cost document, notification document
# ---------------------------------------------------------------------------

_R4 = lambda x: f"CAST(CAST(floor(({x} + 50000) / 100000) AS DOUBLE) / 10000.0 AS VARCHAR)"
COST_CTES = """,
ss AS (SELECT scan_id, sum(cost_nano) AS cn, sum(input_tokens) AS ti, sum(output_tokens) AS tout, count(*) AS calls, min(ts) AS t0,
         CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts)) + 50000) / 100000) AS DOUBLE) / 10.0 AS el FROM cc GROUP BY scan_id),
mm AS (SELECT scan_id, string_agg(""" + J("model") + " || ':' || " + _R4("cn") + """, ',' ORDER BY model) AS m
       FROM (SELECT scan_id, key AS model, sum(cost_nano) AS cn FROM cc GROUP BY ALL) GROUP BY scan_id),
ff AS (SELECT scan_id, file_path, sum(cost_nano) AS cn, row_number() OVER (PARTITION BY scan_id ORDER BY file_path) AS k
       FROM cc WHERE file_path IS NOT NULL AND file_path <> '' GROUP BY scan_id, file_path)
"""
_COST_HEAD = ("'{\"total_cost_usd\":' || " + _R4("cn") + " || ',\"total_input_tokens\":' || CAST(ti AS BIGINT) || ',\"total_output_tokens\":' || CAST(tout AS BIGINT) || "
              "',\"total_tokens\":' || CAST(ti + tout AS BIGINT) || ',\"api_calls\":' || calls || ',\"elapsed_seconds\":' || CAST(el AS VARCHAR) || "
              "',\"start_time\":\"' || strftime(t0, '%Y-%m-%dT%H:%M:%S.%g') || 'Z\",\"costs_by_model\":{' || m || '},\"costs_by_file\":{'")
COST_DOCUMENT = (f"SELECT scan_id, 0 AS part, '' AS ord, {_COST_HEAD} AS text FROM ss JOIN mm USING (scan_id) "
                 f"UNION ALL SELECT scan_id, 1, file_path, CASE WHEN k > 1 THEN ',' ELSE '' END || {J('file_path')} || ':' || {_R4('cn')} FROM ff "
                 "UNION ALL SELECT scan_id, 2, '', '}}' FROM ss")


@register("cost_document", L.rstrip() + COST_CTES + "SELECT * FROM (" + COST_DOCUMENT + ")")
def q_cost_document(spark, sf):
    return R.cost_document(_costs(spark, sf))


_NOTE_DOC = f"""
SELECT repo_id, 0 AS part, CAST(0 AS BIGINT) AS ord, '{{"event":"{dims.TOOL_NAME}.analysis.complete","timestamp":"{RUN_TS}","summary":{{"files_analyzed":' || total_files ||
  ',"total_findings":' || coalesce(g.n, 0) || CASE WHEN by_type <> '' THEN ',"by_vuln_type":{{' || by_type || '}}' ELSE '' END || '}},"findings":[' AS text
FROM sm LEFT JOIN (SELECT repo_id, count(*) AS n FROM fx_findings WHERE {O.sev_rank_case()} >= 2 GROUP BY repo_id) g USING (repo_id)
UNION ALL SELECT repo_id, 1, ord, CASE WHEN ord > 1 THEN ',' ELSE '' END || {obj(('vuln_type', J('vuln_type')), ('severity', J('severity')), ('confidence', 'confidence'), ('file_path', J('file_path')), ('cwe', J('cwe')))}
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY finding_ord) AS BIGINT) AS ord FROM fr WHERE {O.sev_rank_case()} >= 2)
UNION ALL SELECT repo_id, 2, CAST(0 AS BIGINT), ']}}' FROM sm"""


@register("notify_json_document", SM + "SELECT * FROM (" + _NOTE_DOC + ")")
def q_notify_document(spark, sf):
    from auditlens.operators.delivery import notify_json
    return notify_json(R._norm(_findings(spark, sf)), _summary(spark, sf), min_severity="MEDIUM", run_ts=RUN_TS)


@register("sign_notifications", SM + """SELECT repo_id, part, ord, text AS payload,
  'sha256=' || sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode(text)))) AS signature FROM (""".format(ipad=_pads()[0], opad=_pads()[1]) + _NOTE_DOC + ")")
def q_sign_notifications(spark, sf):
    """HMAC signatures over every line of the notification documents."""
    from auditlens.operators.delivery import sign_payloads
    return sign_payloads(q_notify_document(spark, sf).withColumnRenamed("text", "payload"), SECRET)


# ---------------------------------------------------------------------------
# Written reports
# ---------------------------------------------------------------------------

_BAR = "repeat('=', 60)"
_COST_TEXT = f"""
SELECT CAST(scan_id AS VARCHAR) AS repo_id, chr(10) || {_BAR} || chr(10) || '{R.COST_TITLE}' || chr(10) || {_BAR} || chr(10) || 'Total Cost: $' || printf('%.4f', CAST(floor((cn + 50000) / 100000) AS DOUBLE) / 10000.0) ||
  ' USD' || chr(10) || 'Total Tokens: ' || format('{{:,}}', CAST(ti + tout AS BIGINT)) || ' (' || format('{{:,}}', CAST(ti AS BIGINT)) || ' in / ' || format('{{:,}}', CAST(tout AS BIGINT)) || ' out)' || chr(10) ||
  'API Calls: ' || calls || chr(10) || 'Elapsed Time: ' || CAST(el AS VARCHAR) || ' seconds' || chr(10) AS text FROM ss
UNION ALL SELECT CAST(scan_id AS VARCHAR), '{R.BY_MODEL}' FROM ss
UNION ALL SELECT CAST(scan_id AS VARCHAR), '  ' || key || ': $' || printf('%.4f', CAST(floor((sum(cost_nano) + 50000) / 100000) AS DOUBLE) / 10000.0) FROM cc GROUP BY scan_id, key
UNION ALL SELECT DISTINCT CAST(scan_id AS VARCHAR), chr(10) || '{R.TOP_FILES}' FROM ff
UNION ALL SELECT CAST(scan_id AS VARCHAR), '  $' || printf('%.4f', CAST(floor((cn + 50000) / 100000) AS DOUBLE) / 10000.0) || ' - ' || file_path
  FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY cn DESC, file_path) AS r FROM ff) WHERE r <= 10
UNION ALL SELECT CAST(scan_id AS VARCHAR), chr(10) || {_BAR} FROM ss"""

_ALL = " UNION ALL ".join([f"SELECT '{name}' AS format, repo_id, text FROM ({sql})" for name, sql in DOCUMENTS.items()]
                          + [f"SELECT 'cost' AS format, repo_id, text FROM ({_COST_TEXT})",
                             f"SELECT 'cost_json' AS format, CAST(scan_id AS VARCHAR) AS repo_id, text FROM ({COST_DOCUMENT})"])


@register("write_all_reports", SM.rstrip() + ",\n" + L.replace("WITH ", "", 1).rstrip() + COST_CTES.rstrip() + f""",
al AS ({_ALL}),
li AS (SELECT format, repo_id, unnest(string_split(text, chr(10))) AS line FROM al)
SELECT format, repo_id, count(*) AS n_lines, CAST(sum(CAST('0x' || substr(md5(line), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM li GROUP BY ALL""")
def q_write_all(spark, sf):
    """Writes every sink for the run, then reads the written lines back: number and digest by format and document."""
    import uuid

    from auditlens.session import checkpoint_dir
    out = f"{checkpoint_dir(spark).rstrip('/')}/reports/{uuid.uuid4().hex[:10]}"
    paths = R.write_all_reports(R._norm(_findings(spark, sf)), _all_files(spark, sf), out, RUN_TS, calls=_costs(spark, sf), compression="gzip")
    parts = []
    for name, p in paths.items():
        key = "scan_id" if name == "cost_json" else "repo_id"
        lines = spark.read.schema(f"value string, {key} string").text(p)
        parts.append(lines.select(F.lit(name).alias("format"), F.col(key).alias("repo_id"), F.col("value").alias("line")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    number = F.conv(F.substring(F.md5(F.col("line").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return u.groupBy("format", "repo_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(number).alias("digest"))
