"""Input tables: the driver's parquet tables and the fx_* projections.

The fx_* projections are the test inputs described in FIXTURES.md.  They are
plain SQL over the parquet tables so that the same text runs in Spark and in
the DuckDB oracle.  They shape the generated prose into repositories, model
replies, call ledgers and findings; every operator then runs over the whole
projection.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def register_tables(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register the parquet tables of ``sf_dir`` as temp views."""
    for name in names or TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path) or "://" in sf_dir:
            _read(spark, path).createOrReplaceTempView(name)


_READS: dict[tuple[str, str], DataFrame] = {}


def _read(spark: SparkSession, path: str) -> DataFrame:
    """``spark.read.parquet`` memoised per application: a DataFrame is a lazy
    plan, so reusing it only saves the footer/schema job of a new read."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _READS:
        _READS[key] = spark.read.parquet(path)
    return _READS[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _read(spark, os.path.join(sf_dir, f"{name}.parquet"))


#: A line for each family of endpoint rules, in table order.
FAMILY_LINES = [
    'app.route("/a")', "APIRouter()", "urlpatterns = []", "tornado.ioloop", "aiohttp.web.Application", "sanic.Sanic", "falcon.App()", "@cherrypy.expose", "Starlette()",
    "@view_config", "bottle.run()", "quart.Quart()", "request.vars", "@hug.get", "dash.Dash()", "responder.API()", "gr.Blocks()", "ariadne.load", "def lambda_handler(event)",
    "@app.function_name", "functions_framework", "gunicorn", "WEBSOCKET", "grpc.server", "urllib3", "async def get(self)", "lxml.etree", "send_file(p)", "engine.execute", "mark_safe(x)",
]

#: Path of a file (from doc_id, g, rn) and the code above its text: what the SQL and the Spark form of fx_files share.
FILE_PATH = """  CASE WHEN rn = 1 AND g % 5 <> 4 THEN CASE g % 5 WHEN 0 THEN 'README.md' WHEN 1 THEN 'readme.md' WHEN 2 THEN 'README.rst' ELSE 'README' END
       WHEN rn = 2 AND g % 2 = 0 THEN 'README.txt'
       ELSE (CASE doc_id % 12 WHEN 0 THEN 'src/app_' WHEN 1 THEN 'src/api/Views_' WHEN 2 THEN 'tests/case_' WHEN 3 THEN 'src/util/helpers_'
         WHEN 4 THEN 'Docs/conf_' WHEN 5 THEN 'main_' WHEN 6 THEN '.hidden/mod_' WHEN 7 THEN 'src/models_' WHEN 8 THEN 'src/test_' WHEN 9 THEN 'src/.cache/x_'
         WHEN 10 THEN 'src/db_' ELSE 'src/plain_' END) || CAST(doc_id AS STRING) || '.py' END"""
FILE_HEAD = """(CASE doc_id % 12
    WHEN 0 THEN '@app.route("/f")' || chr(10) || 'def handler_' || CAST(doc_id AS STRING) || '(request):' || chr(10) || '    return open(request.args["p"]).read()' || chr(10)
    WHEN 1 THEN 'class View_' || CAST(doc_id AS STRING) || '(APIView):' || chr(10) || '    def get(self):' || chr(10) || '        cursor.execute("select " + self.q)' || chr(10) || chr(10) || 'x = 1' || chr(10)
    WHEN 3 THEN 'def helper_' || CAST(doc_id AS STRING) || '(x):' || chr(10) || chr(10) || '    y = x' || chr(10) || '    return y' || chr(10) || '@deco' || chr(10) || 'async def other(x):' || chr(10) || '    pass' || chr(10)
    WHEN 5 THEN 'requests.get(url)' || chr(10) || 'cfg_' || CAST(doc_id AS STRING) || ' = 1' || chr(10)
    WHEN 7 THEN 'class Model_' || CAST(doc_id AS STRING) || ':' || chr(10) || '    def load(self):' || chr(10) || '        return eval(self.s)' || chr(10)
    WHEN 10 THEN 'def run(q):' || chr(10) || '    engine.execute(q)' || chr(10)
    ELSE 'value = 1' || chr(10) END)"""

FX_SQL = {
    "fx_snippets": """
SELECT doc_id, text || chr(10) || CASE doc_id % 31 """ + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(FAMILY_LINES)) + """ ELSE 'plain' END AS content FROM documents
""",
    "fx_files": """
WITH d AS (SELECT doc_id, text, 'repo' || CAST(CAST(floor(doc_id / 50) AS BIGINT) AS STRING) AS repo_id, CAST(floor(doc_id / 50) AS BIGINT) AS g, row_number() OVER (PARTITION BY floor(doc_id / 50) ORDER BY doc_id) AS rn FROM documents),
p AS (SELECT doc_id, repo_id, rn, text,
""" + FILE_PATH + """ AS path FROM d)
SELECT doc_id, repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS file_ord,
  """ + FILE_HEAD + """ || '# ' || replace(text, chr(10), chr(10) || '# ') AS content
FROM p
""",
    "fx_requests": """
WITH m AS (SELECT doc_id, 'repo' || CAST(CAST(floor(doc_id / 50) AS BIGINT) AS STRING) AS repo_id,
  min(CASE WHEN doc_id % 12 = 3 THEN doc_id END) OVER (PARTITION BY floor(doc_id / 50)) AS h,
  min(CASE WHEN doc_id % 12 = 7 THEN doc_id END) OVER (PARTITION BY floor(doc_id / 50)) AS k,
  min(CASE WHEN doc_id % 12 = 5 THEN doc_id END) OVER (PARTITION BY floor(doc_id / 50)) AS c FROM documents)
SELECT doc_id AS request_id, repo_id,
  CASE doc_id % 5 WHEN 0 THEN 'helper_' || coalesce(CAST(h AS STRING),'0') WHEN 1 THEN 'Model_' || coalesce(CAST(k AS STRING),'0') || '.load'
    WHEN 2 THEN 'cfg_' || coalesce(CAST(c AS STRING),'0') WHEN 3 THEN 'a.b.other' ELSE 'missing_' || CAST(doc_id AS STRING) END AS name FROM m
""",
    "fx_calls": """
SELECT event_id AS call_id, user_id % 10 AS scan_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS seq, ts,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE 'src/u' || CAST(user_id AS STRING) || '.py' END AS file_path,
  CASE event_id % 3 WHEN 0 THEN 'initial' WHEN 1 THEN 'secondary-LFI' ELSE 'secondary-RCE' END AS call_type,
  CASE WHEN user_id % 7 = 0 THEN 'ollama/llama3.2' ELSE CASE event_type WHEN 'view' THEN 'openai/gpt-4o' WHEN 'click' THEN 'anthropic/claude-3-haiku-20240307'
    WHEN 'purchase' THEN 'openai/GPT-4o-mini' WHEN 'signup' THEN 'anthropic/claude-9-x' ELSE 'mystery-model' END END AS model,
  CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens FROM events
""",
    "fx_findings": """
SELECT o_orderkey AS finding_ord, 'r' || CAST(o_custkey % 20 AS STRING) AS repo_id, 'src/c' || CAST(o_custkey AS STRING) || '.py' AS file_path,
  CASE CAST(floor(o_custkey / 20) AS BIGINT) % 8 WHEN 0 THEN 'LFI' WHEN 1 THEN 'RCE' WHEN 2 THEN 'SSRF' WHEN 3 THEN 'AFO' WHEN 4 THEN 'SQLI' WHEN 5 THEN 'XSS' WHEN 6 THEN 'IDOR' ELSE 'OTHER' END AS vuln_type,
  CAST(o_orderkey % 11 AS INT) AS confidence,
  CASE WHEN o_orderkey % 11 >= 9 THEN 'CRITICAL' WHEN o_orderkey % 11 >= 7 THEN 'HIGH' WHEN o_orderkey % 11 >= 5 THEN 'MEDIUM' WHEN o_orderkey % 11 >= 3 THEN 'LOW' ELSE 'INFO' END AS severity,
  CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 300 + 1 END AS start_line, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 300 + 9 END AS end_line,
  'Priority ' || o_orderpriority || ', status "' || o_orderstatus || '" <b>' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '</b>' AS analysis,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'step ' || CAST(o_orderkey AS STRING) END AS poc,
  CASE WHEN o_orderkey % 6 = 0 THEN 'ctx' || chr(10) || 'line' ELSE '' END AS context_code, o_orderdate AS discovered_at FROM orders
""",
    "fx_issues": """
SELECT DISTINCT '[audit] ' || (CASE CAST(floor(o_custkey / 20) AS BIGINT) % 8 WHEN 0 THEN 'LFI' WHEN 1 THEN 'RCE' WHEN 2 THEN 'SSRF' WHEN 3 THEN 'AFO' WHEN 4 THEN 'SQLI' WHEN 5 THEN 'XSS' WHEN 6 THEN 'IDOR' ELSE 'OTHER' END) || ' vulnerability in src/c' || CAST(o_custkey AS STRING) || '.py' AS title,
  CASE o_custkey % 6 WHEN 0 THEN 'open' WHEN 3 THEN 'closed' ELSE 'none' END AS state FROM orders
""",
    "fx_trace": """
WITH t AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS round FROM lineitem)
SELECT 'src/o' || CAST(l_orderkey AS STRING) || '.py' AS file_path, 'LFI' AS vuln_type, round,
  CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'f' || CAST(l_partkey % 3 AS STRING) WHEN 2 THEN 'g,f' WHEN 3 THEN 'f,g' ELSE 'a,b,c' END AS names FROM t
""",
    "fx_responses": """
SELECT doc_id, 'repo' || CAST(CAST(floor(doc_id / 50) AS BIGINT) AS STRING) AS repo_id, doc_id % 8 AS defect,
  CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN '```json' || chr(10) WHEN 2 THEN 'Here it is: ' ELSE '' END ||
  CASE WHEN doc_id % 8 = 3 THEN ' Checked input", ' ELSE '{"scratchpad": "1. Checked input", ' END ||
  '"analysis": "doc ' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 8 = 4 THEN ' name = ' || chr(92) || '''x' || chr(92) || '''' ELSE '' END || '", "poc": ' || CASE WHEN doc_id % 3 = 0 THEN 'None' ELSE '"p"' END ||
  ', "confidence_score": ' || CAST(CASE WHEN doc_id % 8 = 5 THEN 11 ELSE doc_id % 11 END AS STRING) ||
  ', "vulnerability_types": ["' || CASE WHEN doc_id % 8 = 6 THEN 'BOGUS' ELSE 'SQLI' END || '"]' || CASE WHEN doc_id % 8 = 7 THEN '' ELSE ', "context_code": []' END || '}' ||
  CASE doc_id % 8 WHEN 1 THEN chr(10) || '```' WHEN 2 THEN ' done.' ELSE '' END AS raw FROM documents
""",
    "fx_completed": """
SELECT doc_id, 'repo' || CAST(CAST(floor(doc_id / 50) AS BIGINT) AS STRING) AS repo_id, CASE WHEN doc_id < 50 THEN 'not_started' WHEN doc_id % 3 = 0 OR floor(doc_id / 50) = 1 THEN 'complete' ELSE 'pending' END AS status FROM documents
""",
    "fx_options": """
SELECT n_name AS repo_id, CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey AS DOUBLE) END AS in_budget, CASE WHEN n_nationkey % 4 = 0 THEN 8 END AS in_min_confidence,
  CASE WHEN n_nationkey % 5 = 0 THEN 'LFI,RCE' ELSE '' END AS in_types,
  CASE WHEN n_nationkey % 5 = 3 THEN '{"budget": 4, "provider": "openai", "model": "m1", "dry_run": true, "vuln_types": ["SQLI"], "include_paths": ["src/"], "cost": {"budget": ' || CAST(n_nationkey AS STRING)
    || '}, "llm": {"provider": "anthropic", "model": ""}, "analysis": {' || CASE WHEN n_nationkey % 2 = 0 THEN '"vuln_types": ["XSS", "SSRF"], ' ELSE '' END || '"exclude_paths": ["tests/", "docs/"], "max_iterations": 2}}'
  ELSE '# cfg' || chr(10) || 'budget: ' || CAST(n_nationkey + 0 AS STRING) || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || 'max_iterations: 3' || chr(10) || 'dry_run: true' || chr(10) || 'provider: openai' ELSE '' END || chr(10) || 'model: ~' END AS cfg_text FROM nation
""",
    "fx_refs": """
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'https://github.com/o' || CAST(c_nationkey AS STRING) || '/r' || CAST(c_custkey % 9 AS STRING) WHEN 1 THEN 'http://github.com/o' || CAST(c_nationkey AS STRING) || '/r' || CAST(c_custkey % 9 AS STRING) || '.git'
  WHEN 2 THEN 'o' || CAST(c_nationkey AS STRING) || '/r1' WHEN 3 THEN 'https://gitlab.com/a/b' WHEN 4 THEN '/local/path' ELSE 'plain' END AS ref FROM customer
""",
}

# Which base tables each projection reads.
FX_BASE = {
    "fx_snippets": ["documents"], "fx_files": ["documents"], "fx_requests": ["documents"], "fx_calls": ["events"],
    "fx_findings": ["orders"], "fx_issues": ["orders"], "fx_trace": ["lineitem"],
    "fx_responses": ["documents"], "fx_completed": ["documents"], "fx_options": ["nation"],
    "fx_refs": ["customer"],
}


#: Projections that are one map over their table.
FX_MAPS = {"fx_snippets", "fx_findings", "fx_responses", "fx_completed", "fx_options", "fx_refs"}


def _files_projection(docs: DataFrame) -> DataFrame:
    """fx_files with its numbers taken from narrow rows: the rows of ``FX_SQL``, with one shuffle of the texts and no sort of them.

    A row is known by its place in the table's files, so doc_ids may repeat or be
    null.  Files are numbered by group instead of by ``repo_id``, which names it.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    g = F.expr("CAST(floor(doc_id / 50) AS BIGINT)")
    rows = (docs.select("doc_id", g.alias("g"), *place)
            .withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("doc_id")))
            .withColumn("path", F.expr(FILE_PATH))
            .withColumn("file_ord", F.row_number().over(Window.partitionBy("g").orderBy("path")).cast("bigint")))
    numbered = rows.select("_file", "_row", "path", "file_ord")
    # hash join: the texts stream past the narrow rows of their partition, unsorted
    return (docs.select("doc_id", "text", *place).join(numbered.hint("shuffle_hash"), ["_file", "_row"])
            .select("doc_id", F.concat(F.lit("repo"), g.cast("string")).alias("repo_id"), "path", "file_ord",
                    F.expr(FILE_HEAD + " || '# ' || replace(text, chr(10), chr(10) || '# ')").alias("content")))


def fixture(spark: SparkSession, sf_dir: str, name: str, materialize: bool = True) -> DataFrame:
    """One fx_* projection over the parquet tables of ``sf_dir``.

    By default the projection is written once as a parquet table in the
    session's shared checkpoint folder and read from there afterwards, so it
    behaves like any input table (scan, pruning, pushdown) instead of being
    re-derived (with its window shuffles) by every query that uses it.
    """
    if not materialize:
        register_tables(spark, sf_dir, FX_BASE[name])
        return spark.sql(FX_SQL[name])
    from pyspark.errors import AnalysisException

    from auditlens.session import checkpoint_dir

    tag = hashlib.sha1(("v3" + os.path.abspath(sf_dir) + FX_SQL[name]).encode()).hexdigest()[:12]
    path = f"{checkpoint_dir(spark).rstrip('/')}/fixtures/{name}-{tag}"
    key = (spark.sparkContext.applicationId, path)
    if key in _READS:
        return _READS[key]
    try:
        return _read(spark, path)
    except AnalysisException:
        if name == "fx_files":
            _files_projection(table(spark, sf_dir, "documents")).write.mode("overwrite").parquet(path)
            return _read(spark, path)
        register_tables(spark, sf_dir, FX_BASE[name])
        df = spark.sql(FX_SQL[name])
        # row_number() is INT in Spark and BIGINT in SQL engines; ordinals are BIGINT here
        df = df.select(*[F.col(c).cast("bigint").alias(c) if c in ("file_ord", "seq", "round") else F.col(c)
                         for c in df.columns])
        # several files, as landed tables have: input splits then spread the
        # (CPU-heavy, text) work over all cores without any extra shuffle; a
        # map over a table that is read by as many tasks is written as it comes
        cores = spark.sparkContext.defaultParallelism
        if name not in FX_MAPS or table(spark, sf_dir, FX_BASE[name][0]).rdd.getNumPartitions() < cores:
            df = df.repartition(2 * cores)
        df.write.mode("overwrite").parquet(path)
        return _read(spark, path)


def with_fixtures(*names: str) -> str:
    """SQL ``WITH`` prefix defining the named projections (for oracles)."""
    return "WITH " + ",\n".join(f"{n} AS ({FX_SQL[n]})" for n in names) + "\n"
