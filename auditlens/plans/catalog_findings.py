"""Registered queries: reply ingestion, finding filters, counts, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlens.plans import oracle as O
from auditlens.plans.catalog import register
from auditlens.sources.tables import fixture, with_fixtures

RUN_TS = "2024-01-01 00:00:00"

# ---------------------------------------------------------------------------
# 2.6 Reply ingestion
# ---------------------------------------------------------------------------

_PROVIDER = "CASE WHEN doc_id % 4 = 3 THEN 'anthropic' ELSE 'openai' END"


def _responses(spark, sf):
    return fixture(spark, sf, "fx_responses").withColumn("provider", F.expr(_PROVIDER))


# The oracle engine has no look-around; the fixture's only escape defect is
# \' (never preceded by a backslash), so a plain class rewrite is equivalent.
_REPAIR_SQL = with_fixtures("fx_responses") + f""",
a AS (SELECT doc_id, defect, {_PROVIDER} AS provider, raw FROM fx_responses),
b AS (SELECT doc_id, defect, CASE WHEN provider = 'anthropic' AND NOT starts_with(regexp_replace(raw, '^\\s+', ''), '{{')
        THEN {O.q('{"scratchpad": "1.')} || raw ELSE raw END AS s FROM a),
c AS (SELECT doc_id, defect, regexp_replace(regexp_replace(s, '(?i)```json\\s*', '', 'g'), '```\\s*', '', 'g') AS s FROM b),
d AS (SELECT doc_id, defect, CASE WHEN regexp_matches(s, '(?s)\\{{.*\\}}') THEN regexp_extract(s, '(?s)\\{{.*\\}}') ELSE s END AS s FROM c),
e AS (SELECT doc_id, defect, regexp_replace(s, '\\\\([^"\\\\/bfnrtu])', '\\1', 'g') AS s FROM d),
f AS (SELECT doc_id, defect, regexp_replace(regexp_replace(regexp_replace(s, '\\bNone\\b', 'null', 'g'), '\\bTrue\\b', 'true', 'g'), '\\bFalse\\b', 'false', 'g') AS s FROM e)
SELECT doc_id, defect, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS repaired FROM f
"""


@register("repair_responses", _REPAIR_SQL.rstrip() + "\n")
def q_repair(spark, sf):
    from auditlens.operators.responses import repair_responses
    return repair_responses(_responses(spark, sf)).select("doc_id", "defect", "repaired")


_TYPES = "('LFI','RCE','SSRF','AFO','SQLI','XSS','IDOR')"
_PARSE_SQL = _REPAIR_SQL.replace("SELECT doc_id, defect, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS repaired FROM f",
                                 "") + f""",
g AS (SELECT doc_id, defect, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS repaired FROM f),
h AS (SELECT *, CASE WHEN json_valid(repaired) THEN repaired END AS j FROM g),
v AS (SELECT *, coalesce(json_type(j) = 'OBJECT'
      AND json_type(j, '$.scratchpad') = 'VARCHAR' AND json_type(j, '$.analysis') = 'VARCHAR'
      AND (json_type(j, '$.poc') IS NULL OR json_type(j, '$.poc') IN ('VARCHAR', 'NULL'))
      AND json_type(j, '$.confidence_score') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
      AND CAST(json_extract(j, '$.confidence_score') AS DOUBLE) BETWEEN 0 AND 10
      AND json_type(j, '$.vulnerability_types') = 'ARRAY'
      AND coalesce(list_bool_and(list_transform(CAST(json_extract(j, '$.vulnerability_types[*]') AS JSON[]),
            lambda x: json_type(x) = 'VARCHAR' AND json_extract_string(x, '$') IN {_TYPES})), TRUE)
      AND json_type(j, '$.context_code') = 'ARRAY'
      AND coalesce(list_bool_and(list_transform(CAST(json_extract(j, '$.context_code[*]') AS JSON[]),
            lambda x: json_type(x, '$.name') = 'VARCHAR' AND json_type(x, '$.reason') = 'VARCHAR' AND json_type(x, '$.code_line') = 'VARCHAR')), TRUE),
      FALSE) AS ok FROM h)
SELECT doc_id, defect, ok,
  CASE WHEN ok THEN json_extract_string(j, '$.scratchpad') ELSE repaired END AS scratchpad,
  CASE WHEN ok THEN json_extract_string(j, '$.analysis') ELSE 'Failed to parse structured response' END AS analysis,
  CASE WHEN ok THEN json_extract_string(j, '$.poc') END AS poc,
  CASE WHEN ok THEN CAST(json_extract(j, '$.confidence_score') AS DOUBLE) ELSE 0.0 END AS confidence_score,
  CASE WHEN ok THEN array_to_string(json_extract_string(j, '$.vulnerability_types[*]'), ',') ELSE '' END AS types,
  CAST(CASE WHEN ok THEN json_array_length(j, '$.context_code') ELSE 0 END AS BIGINT) AS n_context
FROM v
"""


def _parsed(spark, sf):
    from auditlens.operators.responses import parse_responses, repair_responses
    rep = repair_responses(_responses(spark, sf)).select("doc_id", "repo_id", "defect", "repaired")
    return parse_responses(rep)[0]


@register("parse_responses", _PARSE_SQL)
def q_parse(spark, sf):
    p = _parsed(spark, sf)
    return p.select("doc_id", "defect", "ok", "scratchpad", "analysis", "poc", "confidence_score",
                    F.array_join("vulnerability_types", ",").alias("types"),
                    F.size("context_code").cast("bigint").alias("n_context"))


_FIND_SQL = _PARSE_SQL.replace("SELECT doc_id, defect, ok,\n  CASE WHEN ok THEN json_extract_string(j, '$.scratchpad')",
                               "SELECT doc_id, defect, ok, j,\n  CASE WHEN ok THEN json_extract_string(j, '$.scratchpad')", 1)
_FIND_SQL = "WITH parsed AS (" + _FIND_SQL + f"""),
t AS (SELECT doc_id, confidence_score AS confidence, unnest(json_extract_string(j, '$.vulnerability_types[*]')) AS vuln_type
      FROM parsed WHERE ok)
SELECT doc_id, 'auditlens/' || vuln_type AS rule_id, vuln_type || ' vulnerability in r' || CAST(doc_id AS STRING) || '.py' AS title,
  'src/r' || CAST(doc_id AS STRING) || '.py' AS file_path, confidence, {O.severity_case('confidence')} AS severity,
  vuln_type, coalesce(rd.cwe, 'CWE-0') AS cwe, coalesce(rd.cwe_name, 'Unknown') AS cwe_name
FROM t LEFT JOIN {O.rule_values()} USING (vuln_type)
"""


@register("responses_to_findings", _FIND_SQL)
def q_resp_findings(spark, sf):
    from auditlens.operators.responses import responses_to_findings
    p = _parsed(spark, sf).filter("ok").withColumn("file_path", F.concat(F.lit("src/r"), F.col("doc_id").cast("string"), F.lit(".py")))
    f = responses_to_findings(p.select("doc_id", "file_path", "scratchpad", "analysis", "poc", "confidence_score",
                                       "vulnerability_types"), run_ts=RUN_TS, extra=("doc_id",))
    return f.select("doc_id", "rule_id", "title", "file_path", "confidence", "severity", "vuln_type", "cwe", "cwe_name")


# ---------------------------------------------------------------------------
# 2.2 finding filters, 2.7 counts, 2.8 ordering
# ---------------------------------------------------------------------------

def _findings(spark, sf):
    return fixture(spark, sf, "fx_findings")


FX_F = with_fixtures("fx_findings")


@register("filter_requested_types", FX_F + "SELECT finding_ord, vuln_type FROM fx_findings WHERE vuln_type IN ('LFI', 'RCE')")
def q_req_types(spark, sf):
    from auditlens.operators.findings import filter_requested_types
    return filter_requested_types(_findings(spark, sf), ("LFI", "RCE", "OTHER")).select("finding_ord", "vuln_type")


@register("filter_min_confidence", FX_F + "SELECT finding_ord, confidence FROM fx_findings WHERE confidence >= 5")
def q_min_conf(spark, sf):
    from auditlens.operators.findings import filter_min_confidence
    return filter_min_confidence(_findings(spark, sf), 5).select("finding_ord", "confidence")


@register("filter_min_severity", FX_F + f"SELECT finding_ord, severity FROM fx_findings WHERE {O.sev_rank_case()} >= 3")
def q_min_sev(spark, sf):
    from auditlens.operators.findings import filter_min_severity
    return filter_min_severity(_findings(spark, sf), "HIGH").select("finding_ord", "severity")


@register("count_by_vuln_type", FX_F + "SELECT repo_id, vuln_type, count(*) AS n FROM fx_findings GROUP BY ALL")
def q_cnt_type(spark, sf):
    from auditlens.operators.findings import count_by_vuln_type
    return count_by_vuln_type(_findings(spark, sf))


@register("count_by_confidence", FX_F + f"SELECT repo_id, {O.bucket_case()} AS bucket, count(*) AS n FROM fx_findings GROUP BY ALL")
def q_cnt_conf(spark, sf):
    from auditlens.operators.findings import count_by_confidence
    return count_by_confidence(_findings(spark, sf))


_SEV_ORD = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 99 END"


@register("count_by_severity", FX_F + f"SELECT repo_id, severity, count(*) AS n, {_SEV_ORD} AS sev_ord FROM fx_findings GROUP BY ALL")
def q_cnt_sev(spark, sf):
    from auditlens.operators.findings import count_by_severity
    return count_by_severity(_findings(spark, sf))


def _all_files(spark, sf):
    """Listed files per repository (the fx_files tree keyed like fx_findings)."""
    return fixture(spark, sf, "fx_files").select(F.concat(F.lit("r"), (F.col("doc_id") % 20).cast("string")).alias("repo_id"), "path")


@register("scan_summary", with_fixtures("fx_findings", "fx_files") + f""",
af AS (SELECT 'r' || CAST(doc_id % 20 AS STRING) AS repo_id, count(*) AS total_files FROM fx_files GROUP BY 1),
t AS (SELECT repo_id, string_agg(k || '=' || CAST(n AS STRING), ';' ORDER BY k) AS s FROM (SELECT repo_id, vuln_type AS k, count(*) AS n FROM fx_findings GROUP BY ALL) GROUP BY repo_id),
b AS (SELECT repo_id, string_agg(k || '=' || CAST(n AS STRING), ';' ORDER BY k) AS s FROM (SELECT repo_id, {O.bucket_case()} AS k, count(*) AS n FROM fx_findings GROUP BY ALL) GROUP BY repo_id),
v AS (SELECT repo_id, string_agg(k || '=' || CAST(n AS STRING), ';' ORDER BY k) AS s FROM (SELECT repo_id, severity AS k, count(*) AS n FROM fx_findings GROUP BY ALL) GROUP BY repo_id),
tot AS (SELECT repo_id, count(*) AS n FROM fx_findings GROUP BY repo_id)
SELECT af.repo_id, CAST(coalesce(af.total_files, 0) AS BIGINT) AS total_files, CAST(coalesce(tot.n, 0) AS BIGINT) AS total_findings,
  coalesce(t.s, '') AS by_vuln_type, coalesce(b.s, '') AS by_confidence, coalesce(v.s, '') AS by_severity
FROM af FULL JOIN tot USING (repo_id) LEFT JOIN t USING (repo_id) LEFT JOIN b USING (repo_id) LEFT JOIN v USING (repo_id)
""")
def q_scan_summary(spark, sf):
    from auditlens.operators.findings import scan_summary
    return scan_summary(_findings(spark, sf), _all_files(spark, sf))


_ORDER = f"{O.sev_score_case()} DESC, confidence DESC, finding_ord"


@register("sort_findings", FX_F + f"SELECT row_number() OVER (ORDER BY {_ORDER}) AS pos, finding_ord, severity, confidence FROM fx_findings")
def q_sort(spark, sf):
    """The sorted rows with the place where the sort put them: rows of earlier
    partitions (one count each) plus the place in the partition."""
    import uuid

    from pyspark.sql import Window

    from auditlens.functions.plan import cut_lineage
    from auditlens.operators.findings import sort_findings
    placed = sort_findings(_findings(spark, sf)).select("finding_ord", "severity", "confidence", F.monotonically_increasing_id().alias("_at"))
    placed = (cut_lineage(placed, f"sorted/{uuid.uuid4().hex}")
              .withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(starts, "_part").select((F.col("_before") + F.col("_at") + 1).alias("pos"), "finding_ord", "severity", "confidence")


@register("number_findings", FX_F + f"SELECT repo_id, finding_ord, row_number() OVER (PARTITION BY repo_id ORDER BY {_ORDER}) AS pos FROM fx_findings")
def q_number(spark, sf):
    from auditlens.operators.findings import number_findings
    return number_findings(_findings(spark, sf)).select("repo_id", "finding_ord", "pos")


@register("top_findings", FX_F + f"""
SELECT repo_id, finding_ord, severity, pos, greatest(n_total - 5, 0) AS n_more FROM (
  SELECT repo_id, finding_ord, severity, row_number() OVER (PARTITION BY repo_id ORDER BY {O.sev_score_case()} DESC, finding_ord) AS pos,
         count(*) OVER (PARTITION BY repo_id) AS n_total FROM fx_findings) WHERE pos <= 5
""")
def q_top(spark, sf):
    from auditlens.operators.findings import top_findings
    return top_findings(_findings(spark, sf), 5).select("repo_id", "finding_ord", "severity", "pos", "n_more")


@register("collect_findings", FX_F + "SELECT repo_id, count(*) AS n, count(DISTINCT file_path) AS n_files FROM fx_findings GROUP BY repo_id")
def q_collect(spark, sf):
    from auditlens.operators.scoring import collect_findings
    f = _findings(spark, sf)
    hi = F.col("severity").isin("CRITICAL", "HIGH")
    parts = [f.filter(hi), f.filter(~hi)]  # per-batch result tables, flattened back
    return (collect_findings(*parts).groupBy("repo_id")
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_path").alias("n_files")))
