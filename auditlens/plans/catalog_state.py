"""Registered queries: resume state and option precedence."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlens.plans import oracle as O
from auditlens.plans.catalog import register
from auditlens.plans.catalog_symbols import WS
from auditlens.sources.tables import fixture, with_fixtures

T0, T1 = "2024-01-01 00:00:00", "2024-01-02 00:00:00"


def _files(spark, sf):
    return fixture(spark, sf, "fx_files").select("repo_id", "doc_id", "path")


def _state(spark, sf):
    return fixture(spark, sf, "fx_completed").withColumn("updated_at", F.lit(T0).cast("timestamp"))


KEYS = ("repo_id", "doc_id")
FS = with_fixtures("fx_files", "fx_completed").rstrip() + ",\nrec AS (SELECT * FROM fx_completed WHERE status <> 'not_started')\n"


@register("pending_files", FS + """
SELECT f.repo_id, f.doc_id, f.path FROM fx_files f
WHERE NOT EXISTS (SELECT 1 FROM fx_completed c WHERE c.status = 'complete' AND c.repo_id = f.repo_id AND c.doc_id = f.doc_id)""")
def q_pending(spark, sf):
    from auditlens.operators.state import pending_files
    return pending_files(_files(spark, sf), _state(spark, sf), KEYS)


# Updates: every file that passes the endpoint filter is analysed at T1; the
# files of the same runs that do not pass (skipped) are re-recorded pending.
@register("mark_complete", FS + f""",
u AS (SELECT repo_id, doc_id, CASE WHEN {O.network_sql('content')} THEN 'complete' ELSE 'pending' END AS status FROM fx_files),
a AS (SELECT repo_id, doc_id, status, TIMESTAMP '{T0}' AS updated_at FROM rec
      UNION ALL SELECT repo_id, doc_id, status, TIMESTAMP '{T1}' FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, doc_id ORDER BY updated_at DESC, CASE WHEN status = 'complete' THEN 1 ELSE 0 END DESC) AS rk FROM a)
SELECT repo_id, doc_id, status, updated_at FROM r WHERE rk = 1""")
def q_mark(spark, sf):
    from auditlens.operators.patterns import network_predicate
    from auditlens.operators.state import mark_complete
    f = fixture(spark, sf, "fx_files")
    upd = f.select("repo_id", "doc_id", F.when(network_predicate("content"), F.lit("complete")).otherwise(F.lit("pending")).alias("status"),
                   F.lit(T1).cast("timestamp").alias("updated_at"))
    return mark_complete(_state(spark, sf), upd, KEYS)


@register("progress_summary", FS + """,
a AS (SELECT repo_id, count(*) AS total_files, count(*) FILTER (WHERE status = 'complete') AS completed_files,
             count(*) FILTER (WHERE status <> 'complete') AS pending_files FROM rec GROUP BY repo_id),
r AS (SELECT DISTINCT repo_id FROM fx_files)
SELECT r.repo_id, CASE WHEN a.total_files IS NULL THEN 'not_started' WHEN a.pending_files > 0 THEN 'in_progress' ELSE 'complete' END AS status,
  CAST(coalesce(a.total_files, 0) AS BIGINT) AS total_files, CAST(coalesce(a.completed_files, 0) AS BIGINT) AS completed_files,
  CAST(coalesce(a.pending_files, 0) AS BIGINT) AS pending_files,
  CASE WHEN coalesce(a.total_files, 0) > 0 THEN CAST((a.completed_files * 2000 + a.total_files) // (2 * a.total_files) AS DOUBLE) / 10.0 ELSE 0.0 END AS progress_percent
FROM r LEFT JOIN a USING (repo_id)""")
def q_progress(spark, sf):
    from auditlens.operators.state import progress_summary
    return progress_summary(_state(spark, sf), _files(spark, sf))


@register("resumable_scans", FS + """
SELECT repo_id, count(*) FILTER (WHERE status <> 'complete') AS pending FROM rec GROUP BY repo_id HAVING pending > 0""")
def q_resumable(spark, sf):
    from auditlens.operators.state import resumable_scans
    return resumable_scans(_state(spark, sf))


def _state_json(spark, sf):
    """One JSON state record per repository: camelCase for even groups,
    snake_case for odd ones (two writer versions)."""
    c = fixture(spark, sf, "fx_completed")
    g = c.groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("status") == "complete", F.col("doc_id").cast("string")))).alias("done"),
        F.array_sort(F.collect_list(F.when(F.col("status") != "complete", F.col("doc_id").cast("string")))).alias("todo"))
    even = F.substring("repo_id", 5, 10).cast("int") % 2 == 0
    camel = F.to_json(F.struct(F.col("done").alias("completedFiles"), F.col("todo").alias("pendingFiles"),
                               F.col("repo_id").alias("repoPath"), F.lit("m1").alias("model"), F.array(F.struct(F.size("done").alias("n"))).alias("results"),
                               F.struct(F.size("todo").alias("calls")).alias("costTrackerData")))
    snake = F.to_json(F.struct(F.col("done").alias("completed_files"), F.col("todo").alias("pending_files"),
                               F.col("repo_id").alias("repo_path"), F.lit("0.9").alias("legacy_version")))
    return g.select("repo_id", F.when(even, camel).otherwise(snake).alias("json"))


@register("normalize_state", with_fixtures("fx_completed") + """,
g AS (SELECT repo_id, list(CAST(doc_id AS STRING) ORDER BY CAST(doc_id AS STRING)) FILTER (WHERE status = 'complete') AS done,
             list(CAST(doc_id AS STRING) ORDER BY CAST(doc_id AS STRING)) FILTER (WHERE status <> 'complete') AS todo FROM fx_completed GROUP BY repo_id)
SELECT repo_id, CAST(coalesce(len(done), 0) AS INTEGER) AS n_completed, CAST(coalesce(len(todo), 0) AS INTEGER) AS n_pending,
  array_to_string(coalesce(done, []), ',') AS completed, repo_id AS repo_path,
  CASE WHEN CAST(substr(repo_id, 5) AS INTEGER) % 2 = 0 THEN 'm1' END AS model,
  CASE WHEN CAST(substr(repo_id, 5) AS INTEGER) % 2 = 0 THEN '[{"n":' || coalesce(len(done), 0) || '}]' ELSE '[]' END AS results,
  CASE WHEN CAST(substr(repo_id, 5) AS INTEGER) % 2 = 0 THEN '{"calls":' || coalesce(len(todo), 0) || '}' END AS cost_tracker_data,
  CASE WHEN CAST(substr(repo_id, 5) AS INTEGER) % 2 = 0 THEN '1.0.0' ELSE '0.9' END AS version FROM g""")
def q_normalize(spark, sf):
    from auditlens.operators.state import normalize_state
    n = normalize_state(_state_json(spark, sf), legacy_version_keys=("legacy_version",))
    return n.select("repo_id", F.size("completed_files").alias("n_completed"), F.size("pending_files").alias("n_pending"),
                    F.array_join("completed_files", ",").alias("completed"), "repo_path", "model", "results", "cost_tracker_data", "version")


_TRIM = f"'^{WS}+|{WS}+$'"


@register("resolve_scan_options", with_fixtures("fx_options") + f""",
l AS (SELECT repo_id, generate_subscripts(arr, 1) AS i, regexp_replace(unnest(arr), {_TRIM}, '', 'g') AS line
      FROM (SELECT repo_id, string_split(cfg_text, chr(10)) AS arr FROM fx_options)),
kv AS (SELECT repo_id, i, regexp_replace(split_part(line, ':', 1), {_TRIM}, '', 'g') AS k,
              regexp_replace(substr(line, strpos(line, ':') + 1), {_TRIM}, '', 'g') AS v
       FROM l WHERE line <> '' AND NOT starts_with(line, '#') AND strpos(line, ':') > 0),
cfg AS (SELECT repo_id, arg_max(CASE WHEN v IN ('null', '~') THEN NULL ELSE v END, i) FILTER (WHERE k = 'budget') AS budget,
               arg_max(CASE WHEN v IN ('null', '~') THEN NULL ELSE v END, i) FILTER (WHERE k = 'confidence_threshold') AS conf,
               arg_max(CASE WHEN v IN ('null', '~') THEN NULL ELSE v END, i) FILTER (WHERE k = 'max_iterations') AS maxi,
               arg_max(CASE WHEN v IN ('null', '~') THEN NULL ELSE v END, i) FILTER (WHERE k = 'model') AS model,
               arg_max(v, i) FILTER (WHERE k = 'provider') AS provider, arg_max(v, i) FILTER (WHERE k = 'dry_run') AS dry FROM kv GROUP BY repo_id),
j AS (SELECT repo_id, json_extract_string(t, '$.cost.budget') AS budget, json_extract_string(t, '$.analysis.max_iterations') AS maxi,
             json_extract_string(t, '$.llm.provider') AS provider, json_extract_string(t, '$.model') AS model, json_extract_string(t, '$.dry_run') AS dry,
             array_to_string(coalesce(CAST(json_extract(t, '$.analysis.vuln_types') AS VARCHAR[]), CAST(json_extract(t, '$.vuln_types') AS VARCHAR[])), ',') AS types,
             array_to_string(CAST(json_extract(t, '$.include_paths') AS VARCHAR[]), ',') AS inc,
             array_to_string(CAST(json_extract(t, '$.analysis.exclude_paths') AS VARCHAR[]), ',') AS exc
      FROM (SELECT repo_id, cfg_text AS t FROM fx_options WHERE starts_with(cfg_text, '{{')))
SELECT o.repo_id,
  coalesce(o.in_budget, CAST(j.budget AS DOUBLE), CASE WHEN regexp_full_match(c.budget, '\\d+(\\.\\d+)?') THEN CAST(c.budget AS DOUBLE) END) AS budget,
  coalesce(CAST(o.in_min_confidence AS DOUBLE), CASE WHEN regexp_full_match(c.conf, '\\d+(\\.\\d+)?') THEN CAST(c.conf AS DOUBLE) END, 5.0) AS min_confidence,
  coalesce(CAST(j.maxi AS DOUBLE), CASE WHEN regexp_full_match(c.maxi, '\\d+(\\.\\d+)?') THEN CAST(c.maxi AS DOUBLE) END, 7.0) AS max_iterations,
  coalesce(j.model, c.model) AS model, coalesce(nullif(o.in_types, ''), j.types, '') AS vuln_types, coalesce(j.provider, c.provider) AS provider,
  coalesce(j.dry, c.dry, 'false') = 'true' AS dry_run, coalesce(j.inc, '') AS include_list, coalesce(j.exc, '') AS exclude_list
FROM fx_options o LEFT JOIN cfg c USING (repo_id) LEFT JOIN j USING (repo_id)""")
def q_options(spark, sf):
    from auditlens.operators.state import resolve_scan_options
    o = resolve_scan_options(fixture(spark, sf, "fx_options"))
    return (o.withColumn("include_list", F.array_join("include_paths", ",")).withColumn("exclude_list", F.array_join("exclude_paths", ","))
            .drop("include_paths", "exclude_paths"))
