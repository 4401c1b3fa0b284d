"""Registered queries: scoring hook, convergence, refinement rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlens.plans import oracle as O
from auditlens.plans.catalog import register
from auditlens.plans.catalog_prompts import _INITIAL
from auditlens.sources.tables import fixture, with_fixtures


def _initial_prompts(spark, sf):
    from auditlens.operators.paths import discover_files
    from auditlens.operators.prompts import build_initial_prompts
    d = discover_files(fixture(spark, sf, "fx_files")).select("repo_id", "path", "content")
    return build_initial_prompts(d)


_RAW = ("""'{"scratchpad": "", "analysis": "sha:' || substr(sha256(p), 1, 8) || '", "poc": null, "confidence_score": ' || """
        """CAST(length(p) % 11 AS VARCHAR) || ', "vulnerability_types": [' || CASE WHEN contains(p, 'execute(') THEN '"SQLI"' ELSE '' END || """
        """'], "context_code": []}'""")


@register("score_prompts", with_fixtures("fx_files") + f""",
d AS (SELECT repo_id, path, content FROM fx_files WHERE {O.keep_path_sql('path')} AND {O.network_sql('content')}),
pp AS (SELECT repo_id, path, {_INITIAL} AS p FROM d),
r AS (SELECT repo_id, path, p, {_RAW} AS raw FROM pp)
SELECT repo_id, path, raw, CAST(ceil(length(p) / 4) AS BIGINT) AS input_tokens, CAST(ceil(length(raw) / 4) AS BIGINT) AS output_tokens,
  CAST(NULL AS VARCHAR) AS error FROM r""")
def q_score(spark, sf):
    from auditlens.operators.scoring import digest_scorer, score_prompts
    return score_prompts(_initial_prompts(spark, sf), digest_scorer)


@register("convergence_stop", with_fixtures("fx_trace") + """,
t AS (SELECT file_path, vuln_type, round, list_sort(list_filter(string_split(names, ','), lambda x: x <> '')) AS n FROM fx_trace),
l AS (SELECT *, lag(n) OVER (PARTITION BY file_path, vuln_type ORDER BY round) AS prev FROM t),
c AS (SELECT file_path, vuln_type, round + 1 AS i,
        CASE WHEN len(n) = 0 THEN 'no_context' WHEN prev IS NOT NULL AND n = prev THEN 'same_names'
             WHEN prev IS NOT NULL AND len(n) = len(prev) THEN 'same_count' END AS reason FROM l WHERE round + 1 < 7),
f AS (SELECT file_path, vuln_type, min(i) AS si, arg_min(reason, i) AS sr FROM c WHERE reason IS NOT NULL GROUP BY ALL),
s AS (SELECT file_path, vuln_type, max(round) AS mr FROM fx_trace GROUP BY ALL)
SELECT s.file_path, s.vuln_type, CAST(coalesce(f.si, least(7, s.mr + 1)) AS BIGINT) AS stop_round,
  coalesce(f.sr, CASE WHEN s.mr + 1 >= 7 THEN 'max_iterations' ELSE 'trace_end' END) AS reason,
  CAST(coalesce(f.si, least(7, s.mr + 1)) - 1 AS BIGINT) AS last_round
FROM s LEFT JOIN f USING (file_path, vuln_type)""")
def q_convergence(spark, sf):
    from auditlens.operators.scoring import convergence_stop
    return convergence_stop(fixture(spark, sf, "fx_trace"), max_iterations=7)


# The stand-in scorer is a function of the file and of whether context arrived, so the rounds
# unroll: round 0 asks for the names called but not defined; round 1 stops if there are none,
# else resolves them and scores again; round 2 sees the same names and stops.
@register("refine_findings", with_fixtures("fx_files") + f""",
allf AS (SELECT repo_id, path, content FROM fx_files WHERE {O.keep_path_sql('path')}),
d AS (SELECT repo_id, path, content, list_distinct(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS called,
        regexp_extract_all(content, '(?:def|class)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS defined FROM allf WHERE {O.network_sql('content')}),
a AS (SELECT repo_id, path, unnest(list_filter(called, lambda x: NOT list_contains(defined, x))) AS name FROM d),
r AS (SELECT a.repo_id, a.path, count(DISTINCT a.name) FILTER (WHERE contains(f.content, a.name)) AS n_found, count(DISTINCT a.name) AS n_names
      FROM a JOIN allf f ON f.repo_id = a.repo_id GROUP BY ALL),
t AS (SELECT repo_id, path, content, unnest(list_filter(['LFI', 'RCE', 'SQLI'], lambda v: contains(content, CASE v WHEN 'LFI' THEN 'open(' WHEN 'RCE' THEN 'eval(' ELSE 'execute(' END))) AS vuln_type FROM d),
o AS (SELECT t.repo_id, t.path, t.vuln_type, CAST(CASE WHEN coalesce(r.n_found, 0) > 0 THEN 8 ELSE 7 END AS DOUBLE) AS confidence,
        CAST(CASE WHEN coalesce(r.n_names, 0) > 0 THEN 1 ELSE 0 END AS BIGINT) AS last_round, CAST(coalesce(r.n_found, 0) AS BIGINT) AS n_context,
        CASE WHEN coalesce(r.n_names, 0) > 0 THEN 'same_names' ELSE 'no_context' END AS stop_reason
      FROM t LEFT JOIN r ON r.repo_id = t.repo_id AND r.path = t.path)
SELECT repo_id, path AS file_path, vuln_type, confidence, {O.severity_case('confidence')} AS severity, last_round, n_context, stop_reason FROM o WHERE confidence >= 5""")
def q_refine(spark, sf):
    """Initial scoring of discovered files, then refinement rounds (stand-in scorer)."""
    from auditlens.operators.findings import filter_min_confidence
    from auditlens.operators.paths import list_all_files
    from auditlens.operators.responses import parse_responses, repair_responses, responses_to_findings
    from auditlens.operators.scoring import context_scorer, score_prompts
    from auditlens.plans.refine import refine
    files = list_all_files(fixture(spark, sf, "fx_files")).select("repo_id", "path", "file_ord", "content")
    ini = score_prompts(_initial_prompts(spark, sf), context_scorer)
    parsed, _ = parse_responses(repair_responses(ini.withColumn("provider", F.lit("openai")), text_col="raw")
                                .select("repo_id", "path", "repaired"))
    pairs = (parsed.select("repo_id", "path", F.explode("vulnerability_types").alias("vuln_type"),
                           F.to_json(F.struct("scratchpad", "analysis", "poc", "confidence_score", "vulnerability_types",
                                              "context_code")).alias("previous")))
    out = refine(files, pairs, context_scorer, max_iterations=7)
    f = responses_to_findings(out.withColumnRenamed("path", "file_path"), run_ts="2024-01-01 00:00:00", extra=("last_round", "n_context", "stop_reason"))
    return filter_min_confidence(f, 5).select("repo_id", "file_path", "vuln_type", "confidence", "severity", F.col("last_round").cast("bigint").alias("last_round"),
                                              F.col("n_context").cast("bigint").alias("n_context"), "stop_reason")
