"""Registered queries: one per operator, each with its DuckDB oracle.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
Every query reads the whole given tables (through the fx_* projections);
nothing is sampled, capped or filtered to keep the check cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.functions import dims
from auditlens.plans import oracle as O
from auditlens.sources.files import SHORT_RE, URL_RE
from auditlens.sources.tables import fixture, table, with_fixtures

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


# ---------------------------------------------------------------------------
# 0. Flagship
# ---------------------------------------------------------------------------

FLAGSHIP_SQL = with_fixtures("fx_files") + f""",
cand AS (SELECT repo_id, path, content FROM fx_files WHERE {O.keep_path_sql('path')} AND {O.network_sql('content')}),
hits AS ({O.family_hits_sql('cand', ['repo_id', 'path'], 'content', dims.SINK_RULES, 'vuln_type')}),
f AS (SELECT repo_id, vuln_type, CAST(least(10, 3 + 2 * n) AS DOUBLE) AS confidence FROM hits)
SELECT repo_id, vuln_type, {O.severity_case('confidence')} AS severity, count(*) AS n_findings,
       CAST(sum(confidence) AS BIGINT) AS sum_confidence
FROM f GROUP BY ALL
"""


@register("findings_by_type_severity", FLAGSHIP_SQL)
def q_flagship(spark, sf):
    from auditlens.plans.flagship import findings_by_type_severity
    return findings_by_type_severity(fixture(spark, sf, "fx_files"))


# ---------------------------------------------------------------------------
# 2.1 Scans and sources
# ---------------------------------------------------------------------------

@register("scan_target", with_fixtures("fx_files") + """
SELECT repo_id, path, path = 'src/api' AS is_single,
       CASE WHEN path = 'src/api' THEN path ELSE substr(path, 9) END AS rel_path
FROM fx_files WHERE path = 'src/api' OR starts_with(path, 'src/api/')
""")
def q_scan_target(spark, sf):
    from auditlens.sources.files import scan_target
    return scan_target(fixture(spark, sf, "fx_files"), "src/api").select("repo_id", "path", "is_single", "rel_path")


@register("file_line_stats", """
SELECT CAST(floor(doc_id / 50) AS BIGINT) AS grp, count(*) AS n_files,
       CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines,
       CAST(max(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS max_lines
FROM documents GROUP BY 1
""")
def q_file_line_stats(spark, sf):
    from auditlens.sources.files import file_line_stats
    docs = table(spark, sf, "documents").withColumn("grp", F.floor(F.col("doc_id") / 50).cast("bigint"))
    return file_line_stats(docs, by=("grp",), content_col="text")


@register("explode_lines", """
SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_no,
       unnest(string_split(text, chr(10))) AS line
FROM documents
""")
def q_explode_lines(spark, sf):
    from auditlens.sources.files import explode_lines
    return explode_lines(table(spark, sf, "documents"), keys=("doc_id",), content_col="text")


@register("pick_readme", with_fixtures("fx_files") + """,
cand AS (SELECT * FROM (VALUES """ + ", ".join(f"({O.q(n)}, {i})" for i, n in enumerate(dims.README_CANDIDATES)) + """) AS c(name, prio)),
best AS (SELECT repo_id, arg_min(path, prio) AS p, arg_min(length(content), prio) AS n
         FROM fx_files JOIN cand ON path = name GROUP BY repo_id)
SELECT r.repo_id, coalesce(b.p, 'none') AS readme_path, b.p IS NOT NULL AS found, CAST(coalesce(b.n, 0) AS BIGINT) AS readme_chars
FROM (SELECT DISTINCT repo_id FROM fx_files) r LEFT JOIN best b USING (repo_id)
""")
def q_pick_readme(spark, sf):
    from auditlens.sources.files import pick_readme
    r = pick_readme(fixture(spark, sf, "fx_files"))
    return r.select("repo_id", "readme_path", "found", F.length("content").cast("bigint").alias("readme_chars"))


_URL, _SHORT = URL_RE, SHORT_RE.replace("\\z", "$")  # RE2's $ is the end of the text


@register("repo_ref_rollup", with_fixtures("fx_refs") + f""",
p AS (SELECT nullif(regexp_extract(ref, {O.q(_URL)}, 1), '') AS uo, regexp_extract(ref, {O.q(_URL)}, 2) AS ur,
             nullif(regexp_extract(ref, {O.q(_SHORT)}, 1), '') AS so, regexp_extract(ref, {O.q(_SHORT)}, 2) AS sr FROM fx_refs),
r AS (SELECT coalesce(uo, so) AS owner, CASE WHEN uo IS NOT NULL THEN ur WHEN so IS NOT NULL THEN sr END AS repo FROM p)
SELECT owner, repo, CASE WHEN owner IS NOT NULL THEN 'https://github.com/' || owner || '/' || repo || '.git' END AS clone_url,
       count(*) AS n FROM r GROUP BY ALL
""")
def q_repo_ref_rollup(spark, sf):
    from auditlens.sources.files import repo_ref_rollup
    return repo_ref_rollup(fixture(spark, sf, "fx_refs"), "ref")


# ---------------------------------------------------------------------------
# 2.2 Filters and predicates
# ---------------------------------------------------------------------------

@register("filter_excluded_paths", with_fixtures("fx_files") + f"""
SELECT repo_id, path, file_ord FROM fx_files WHERE {O.keep_path_sql('path')}
""")
def q_filter_excluded_paths(spark, sf):
    from auditlens.operators.paths import filter_excluded_paths
    return filter_excluded_paths(fixture(spark, sf, "fx_files")).select("repo_id", "path", "file_ord")


@register("list_all_files", with_fixtures("fx_files") + f"""
SELECT repo_id, count(*) AS total, min(path) AS first_path, max(path) AS last_path
FROM fx_files WHERE {O.keep_path_sql('path')} GROUP BY repo_id
""")
def q_list_all_files(spark, sf):
    from auditlens.operators.paths import list_all_files
    return (list_all_files(fixture(spark, sf, "fx_files")).groupBy("repo_id")
            .agg(F.count(F.lit(1)).alias("total"), F.min("path").alias("first_path"), F.max("path").alias("last_path")))


@register("filter_network_files", with_fixtures("fx_files") + f"""
SELECT repo_id, path FROM fx_files WHERE {O.network_sql('content')}
""")
def q_filter_network_files(spark, sf):
    from auditlens.operators.patterns import filter_network_files
    return filter_network_files(fixture(spark, sf, "fx_files")).select("repo_id", "path")


@register("discover_files", with_fixtures("fx_files") + f"""
SELECT repo_id, path FROM fx_files
WHERE (path = 'src' OR starts_with(path, 'src/')) AND (path = 'src' OR ({O.keep_path_sql('substr(path, 5)')} AND {O.network_sql('content')}))
""")
def q_discover_files(spark, sf):
    from auditlens.operators.paths import discover_files
    return discover_files(fixture(spark, sf, "fx_files"), network_only=True, analyze_path="src").select("repo_id", "path")


FAMILY_SQL = with_fixtures("fx_snippets") + f""",
h AS ({O.family_hits_sql('fx_snippets', ['doc_id'], 'content', dims.NETWORK_PATTERNS)})
SELECT family, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_hits FROM h GROUP BY family
"""


@register("pattern_family_hits", FAMILY_SQL)
def q_pattern_family_hits(spark, sf):
    """Every document with a line of one family; all 30 families are hit."""
    from auditlens.operators.patterns import family_rollup, pattern_family_hits
    return family_rollup(pattern_family_hits(fixture(spark, sf, "fx_snippets"), ["doc_id"], "content"))


@register("rule_table_hits", FAMILY_SQL)
def q_rule_table_hits(spark, sf):
    """The same with the rules as a table of rows, through the literal index."""
    from auditlens.operators.patterns import family_rollup, pattern_family_hits
    return family_rollup(pattern_family_hits(fixture(spark, sf, "fx_snippets"), ["doc_id"], "content", dims.pattern_dim(spark)))


@register("filter_by_rule_table", with_fixtures("fx_files") + f"""
SELECT repo_id, path FROM fx_files WHERE {O.network_sql('content')}
""")
def q_filter_by_rule_table(spark, sf):
    from auditlens.operators.patterns import filter_network_files
    return filter_network_files(fixture(spark, sf, "fx_files"), dims.pattern_dim(spark)).select("repo_id", "path")


# User rules over arbitrary text (web pages): families of page features.
PAGE_RULES = [
    ("script", r"(?i)<script"), ("script", r"(?i)javascript:"),
    ("tracking", r"track\("), ("tracking", r"(?i)analytics"),
    ("forms", r"(?i)<form"), ("forms", r"(?i)<input"),
    ("links", r"(?i)<a\s+href"), ("media", r"(?i)<img"), ("title", r"(?i)<title>"),
]


@register("page_rule_hits", f"""
WITH h AS ({O.family_hits_sql('pages', ['page_id'], 'html', PAGE_RULES)})
SELECT page_id, family, n FROM h
""")
def q_page_rule_hits(spark, sf):
    from auditlens.operators.patterns import pattern_family_hits
    return pattern_family_hits(table(spark, sf, "pages"), ["page_id"], "html", PAGE_RULES)


@register("sink_rule_scores", with_fixtures("fx_files") + f""",
h AS ({O.family_hits_sql('fx_files', ['repo_id', 'path'], 'content', dims.SINK_RULES, 'vuln_type')})
SELECT repo_id, path, vuln_type, n, CAST(least(10, 3 + 2 * n) AS INTEGER) AS confidence FROM h
""")
def q_sink_rule_scores(spark, sf):
    from auditlens.operators.patterns import sink_rule_scores
    return sink_rule_scores(fixture(spark, sf, "fx_files"))


from auditlens.plans import catalog_findings, catalog_ledger, catalog_symbols, catalog_prompts, catalog_state, catalog_reports, catalog_documents, catalog_scoring, catalog_streams  # noqa: E402,F401  (register more queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in QUERIES.items() if v[1]}


@register("scan_source_tree", with_fixtures("fx_files") + """
SELECT repo_id, path, CAST(length(content) AS BIGINT) AS n_chars, sha256(content) AS content_sha FROM fx_files WHERE ends_with(path, '.py')""")
def q_scan_tree(spark, sf):
    """The fx_files tree is written out as real files, then scanned back."""
    import uuid

    from auditlens.session import checkpoint_dir
    from auditlens.sources.files import materialize_tree, scan_source_tree
    root = f"{checkpoint_dir(spark).rstrip('/')}/trees/{uuid.uuid4().hex[:10]}"
    materialize_tree(fixture(spark, sf, "fx_files"), root)
    t = scan_source_tree(spark, root)
    return t.select("repo_id", "path", F.length("content").cast("bigint").alias("n_chars"), F.sha2("content", 256).alias("content_sha"))
