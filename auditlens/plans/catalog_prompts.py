"""Registered queries: prompt tables, history window, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlens.functions import dims
from auditlens.plans import oracle as O
from auditlens.plans.catalog import register
from auditlens.plans.catalog_symbols import BASE as SYM_BASE, WS, _all_files, _requests
from auditlens.sources.tables import fixture, table, with_fixtures

_INITIAL = O.nl_join(O.file_code_sql(), O.tag_sql("instructions", O.q(dims.INITIAL_INSTRUCTIONS)),
                     O.tag_sql("analysis_approach", O.q(dims.ANALYSIS_APPROACH)), O.tag_sql("previous_analysis", "''"),
                     O.tag_sql("guidelines", O.q(dims.GUIDELINES)), O.tag_sql("response_format", O.q(dims.RESPONSE_FORMAT)))


@register("build_initial_prompts", with_fixtures("fx_files") + f""",
d AS (SELECT repo_id, path, content FROM fx_files WHERE {O.keep_path_sql('path')} AND {O.network_sql('content')})
SELECT repo_id, path, CAST(length(p) AS BIGINT) AS prompt_chars, sha256(p) AS prompt_sha FROM (SELECT repo_id, path, {_INITIAL} AS p FROM d)""")
def q_initial(spark, sf):
    from auditlens.operators.paths import discover_files
    from auditlens.operators.prompts import build_initial_prompts
    d = discover_files(fixture(spark, sf, "fx_files")).select("repo_id", "path", "content")
    p = build_initial_prompts(d)
    return p.select("repo_id", "path", F.length("prompt").cast("bigint").alias("prompt_chars"), F.sha2("prompt", 256).alias("prompt_sha"))


def _pairs(spark, sf, files):
    from auditlens.operators.patterns import sink_rule_scores
    hits = sink_rule_scores(files).select("repo_id", "path", "vuln_type")
    extra = files.filter(F.col("path").startswith("src/db_")).select("repo_id", "path", F.lit("XXE").alias("vuln_type"))
    return (hits.unionByName(extra)
            .withColumn("previous", F.concat(F.lit('{"analysis": "'), F.col("path"), F.lit('"}'))))


_CTX_SQL = ("'<code>' || chr(10) || '<name>' || name || '</name>' || chr(10) || '<context_name_requested>' || name || "
            "'</context_name_requested>' || chr(10) || '<file_path>' || file_path || '</file_path>' || chr(10) || "
            "'<source>' || source || '</source>' || chr(10) || '</code>'")
_SECOND = O.nl_join(O.file_code_sql("a.path", "a.content"),
                    "coalesce('<context_code>' || x.ctx || '</context_code>', '<context_code></context_code>')",
                    O.tag_sql("example_bypasses", "pd.bypass_text"), O.tag_sql("instructions", "pd.template"),
                    O.tag_sql("analysis_approach", O.q(dims.ANALYSIS_APPROACH)),
                    O.tag_sql("previous_analysis", "pr.previous"), O.tag_sql("guidelines", O.q(dims.GUIDELINES)),
                    O.tag_sql("response_format", O.q(dims.RESPONSE_FORMAT)))


@register("build_secondary_prompts", SYM_BASE + f""",
sh AS ({O.family_hits_sql('allf', ['repo_id', 'path'], 'content', dims.SINK_RULES, 'vuln_type')}),
pr AS (SELECT repo_id, path, vuln_type, '{{"analysis": "' || path || '"}}' AS previous FROM
        (SELECT repo_id, path, vuln_type FROM sh UNION ALL SELECT repo_id, path, 'XXE' FROM allf WHERE starts_with(path, 'src/db_'))),
found AS (SELECT request_id, file_path, source FROM dsrc UNION ALL SELECT request_id, file_path, source FROM rsrc),
ctx AS (SELECT f.repo_id, f.path, q.name, fd.file_path, fd.source
        FROM fx_files f JOIN req q ON q.request_id = f.doc_id JOIN found fd ON fd.request_id = q.request_id),
x AS (SELECT repo_id, path, string_agg({_CTX_SQL}, chr(10) ORDER BY name) AS ctx FROM ctx GROUP BY ALL),
a AS (SELECT repo_id, path, content FROM allf),
o AS (SELECT pr.repo_id, pr.path, pr.vuln_type, CASE WHEN pd.template IS NOT NULL THEN {_SECOND} END AS p,
             CASE WHEN pd.template IS NULL THEN 'Unknown vulnerability type: ' || pr.vuln_type END AS error
      FROM pr JOIN a USING (repo_id, path) LEFT JOIN x USING (repo_id, path) LEFT JOIN {O.prompt_values()} USING (vuln_type))
SELECT repo_id, path, vuln_type, CAST(length(p) AS BIGINT) AS prompt_chars, sha256(p) AS prompt_sha, error FROM o""")
def q_secondary(spark, sf):
    from auditlens.operators.prompts import build_secondary_prompts
    from auditlens.operators.symbols import resolve_symbols_batch
    files = _all_files(spark, sf)
    req = _requests(spark, sf)
    res, _ = resolve_symbols_batch(req, files)
    owner = fixture(spark, sf, "fx_files").select("repo_id", "path", F.col("doc_id").alias("request_id"))
    ctx = (res.filter("found").join(owner.drop("repo_id"), "request_id")
           .select("repo_id", "path", F.lit(1).alias("ord"), "name", F.col("name").alias("requested"), "file_path", "source"))
    p = build_secondary_prompts(_pairs(spark, sf, files), files, ctx)
    return p.select("repo_id", "path", "vuln_type", F.length("prompt").cast("bigint").alias("prompt_chars"),
                    F.sha2("prompt", 256).alias("prompt_sha"), "error")


_PICK = """cand AS (SELECT * FROM (VALUES ('README.md', 0), ('readme.md', 1), ('README.rst', 2), ('README.txt', 3), ('README', 4)) AS c(name, prio)),
best AS (SELECT repo_id, arg_min(content, prio) AS content FROM fx_files JOIN cand ON path = name GROUP BY repo_id)"""


@register("build_readme_prompts", with_fixtures("fx_files") + f""",
{_PICK}
SELECT repo_id, sha256(p) AS prompt_sha, CAST(length(p) AS BIGINT) AS prompt_chars FROM
 (SELECT repo_id, {O.nl_join(O.tag_sql('readme_content', 'content'), O.tag_sql('instructions', O.q(dims.README_INSTRUCTIONS)))} AS p FROM best)""")
def q_readme_prompts(spark, sf):
    from auditlens.operators.prompts import build_readme_prompts
    from auditlens.sources.files import pick_readme
    p = build_readme_prompts(pick_readme(fixture(spark, sf, "fx_files")))
    return p.select("repo_id", F.sha2("prompt", 256).alias("prompt_sha"), F.length("prompt").cast("bigint").alias("prompt_chars"))


@register("build_system_prompts", with_fixtures("fx_files") + f""",
{_PICK},
s AS (SELECT repo_id, CASE WHEN regexp_replace(regexp_extract(content, '(?s)<summary>(.*?)</summary>', 1), '^{WS}+|{WS}+$', '', 'g') <> ''
        THEN regexp_replace(regexp_extract(content, '(?s)<summary>(.*?)</summary>', 1), '^{WS}+|{WS}+$', '', 'g') ELSE content END AS summary FROM best),
r AS (SELECT DISTINCT repo_id FROM fx_files)
SELECT repo_id, sha256(p) AS prompt_sha, CAST(length(p) AS BIGINT) AS prompt_chars FROM
 (SELECT r.repo_id, {O.nl_join(O.tag_sql('instructions', O.q(dims.SYSTEM_INSTRUCTIONS)), O.tag_sql('readme_summary', "coalesce(s.summary, " + O.q(dims.NO_README) + ")"))} AS p
  FROM r LEFT JOIN s USING (repo_id))""")
def q_system_prompts(spark, sf):
    from auditlens.operators.prompts import build_system_prompts, readme_summaries
    from auditlens.sources.files import pick_readme
    files = fixture(spark, sf, "fx_files")
    rd = pick_readme(files).filter("found").select("repo_id", F.col("content").alias("reply"))
    p = build_system_prompts(files, readme_summaries(rd))
    return p.select("repo_id", F.sha2("system_prompt", 256).alias("prompt_sha"), F.length("system_prompt").cast("bigint").alias("prompt_chars"))


@register("readme_summaries", f"""
SELECT page_id, CASE WHEN html IS NULL THEN {O.q(dims.README_FAILED)}
  WHEN regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '^{WS}+|{WS}+$', '', 'g') <> ''
  THEN regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '^{WS}+|{WS}+$', '', 'g') ELSE html END AS summary
FROM pages""")
def q_summaries(spark, sf):
    from auditlens.operators.prompts import readme_summaries
    return readme_summaries(table(spark, sf, "pages"), text_col="html", tag_name="title", keys=("page_id",))


@register("history_window", """
WITH h AS (SELECT conv_id, turn, role, text, row_number() OVER w AS n,
  list('<' || role || '>' || substr(text, 1, 2000) || '</' || role || '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prev
  FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN n > 2 AND len(prev) > 0 THEN array_to_string(prev, chr(10)) END AS context,
  CASE WHEN n > 2 AND len(prev) > 0 THEN '<conversation_context>' || chr(10) || array_to_string(prev, chr(10)) || chr(10) || '</conversation_context>' || chr(10) || chr(10) || text ELSE text END AS prompt
FROM h WHERE role = 'user'""")
def q_history(spark, sf):
    from auditlens.operators.prompts import history_window
    return history_window(table(spark, sf, "conversations"))


@register("preview_plan", with_fixtures("fx_files") + f""",
{_PICK},
af AS (SELECT repo_id, path FROM fx_files WHERE {O.keep_path_sql('path')}),
an AS (SELECT repo_id, path FROM fx_files WHERE {O.keep_path_sql('path')} AND {O.network_sql('content')}),
na AS (SELECT repo_id, count(*) AS n_all FROM af GROUP BY repo_id),
nn AS (SELECT repo_id, count(*) AS n_an FROM an GROUP BY repo_id),
tot AS (SELECT repo_id, coalesce(n_all, 0) AS n_all, coalesce(n_an, 0) AS n_an FROM na FULL JOIN nn USING (repo_id)),
s AS (SELECT repo_id, CASE WHEN regexp_replace(regexp_extract(content, '(?s)<summary>(.*?)</summary>', 1), '^{WS}+|{WS}+$', '', 'g') <> ''
        THEN regexp_replace(regexp_extract(content, '(?s)<summary>(.*?)</summary>', 1), '^{WS}+|{WS}+$', '', 'g') ELSE content END AS summary FROM best),
sl AS (SELECT repo_id, string_split(summary, chr(10)) AS l FROM s),
lines AS (
  SELECT repo_id, 0 AS part, CAST(0 AS BIGINT) AS ord, 'Total Python files: ' || n_all || chr(10) || 'Files to analyze: ' || n_an AS text FROM tot
  UNION ALL SELECT repo_id, 1, CAST(i AS BIGINT), '   ' || l[i] FROM (SELECT repo_id, l, unnest(range(1, least(len(l), 10) + 1)) AS i FROM sl)
  UNION ALL SELECT repo_id, 2, CAST(0 AS BIGINT), '   ... (' || (len(l) - 10) || ' more lines)' FROM sl WHERE len(l) > 10
  UNION ALL SELECT repo_id, 3, CAST(0 AS BIGINT), 'Files to Analyze (' || n_an || ' files):' FROM tot
  UNION ALL SELECT * FROM (SELECT repo_id, 4, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS r, '   ' || lpad(CAST(row_number() OVER (PARTITION BY repo_id ORDER BY path) AS VARCHAR), 3, ' ') || '. ' || path FROM an) WHERE r <= 20
  UNION ALL SELECT repo_id, 5, CAST(0 AS BIGINT), '   ... and ' || (n_an - 20) || ' more files' FROM tot WHERE n_an > 20)
SELECT repo_id, part, ord, text FROM lines""")
def q_preview(spark, sf):
    from auditlens.operators.paths import discover_files, list_all_files
    from auditlens.operators.prompts import readme_summaries
    from auditlens.operators.reports import preview_plan
    from auditlens.sources.files import pick_readme
    files = fixture(spark, sf, "fx_files")
    rd = pick_readme(files).filter("found").select("repo_id", F.col("content").alias("reply"))
    return preview_plan(list_all_files(files), discover_files(files), readme_summaries(rd))
