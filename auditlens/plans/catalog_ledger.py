"""Registered queries: pricing, costs, budget windows, estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlens.plans import oracle as O
from auditlens.plans.catalog import register
from auditlens.sources.tables import fixture, table, with_fixtures

BUDGET = 20.0        # USD per scan
FILE_LIMIT = 2.0     # USD per file
ITER_LIMIT = 3.0     # USD per iteration check
EST_MODEL = "claude-3-haiku-20240307"

L = with_fixtures("fx_calls") + ",\n" + O.pricing_ctes() + "\n"
R4 = "CAST(floor((cost_nano + 50000) / 100000) AS DOUBLE) / 10000.0"
NANO = lambda usd: int(round(usd * 1e9))


def _costs(spark, sf):
    from auditlens.operators.ledger import call_costs
    return call_costs(fixture(spark, sf, "fx_calls"))


@register("resolve_pricing", L + "SELECT key, in_nano, out_nano, match FROM p")
def q_resolve(spark, sf):
    from auditlens.operators.ledger import pricing_key, resolve_pricing
    calls = fixture(spark, sf, "fx_calls")
    return resolve_pricing(calls.select(pricing_key(F.col("model")).alias("key")))


@register("call_costs", L + "SELECT call_id, key, CAST(cost_nano AS BIGINT) AS cost_nano FROM cc")
def q_call_costs(spark, sf):
    return _costs(spark, sf).select("call_id", "key", F.col("cost_nano").cast("bigint").alias("cost_nano"))


_PROV = ("CASE WHEN starts_with(lower(model), 'anthropic/') OR contains(lower(model), 'claude') THEN 'anthropic' "
         "WHEN starts_with(lower(model), 'openai/') OR contains(lower(model), 'gpt') THEN 'openai' "
         "WHEN starts_with(lower(model), 'ollama/') THEN 'ollama' ELSE 'unknown' END")


@register("usage_by_provider", with_fixtures("fx_calls") + f"""
SELECT {_PROV} AS provider, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM fx_calls GROUP BY 1
""")
def q_usage(spark, sf):
    from auditlens.operators.ledger import usage_by_provider
    return usage_by_provider(fixture(spark, sf, "fx_calls"))


@register("cost_by_file", L + f"""SELECT scan_id, file_path, CAST(sum(cost_nano) AS BIGINT) AS cost_nano,
  CAST(floor((sum(cost_nano) + 50000) / 100000) AS DOUBLE) / 10000.0 AS cost_usd
FROM cc WHERE file_path IS NOT NULL AND file_path <> '' GROUP BY scan_id, file_path""")
def q_cost_file(spark, sf):
    from auditlens.operators.ledger import cost_by_file
    return cost_by_file(_costs(spark, sf)).withColumn("cost_nano", F.col("cost_nano").cast("bigint"))


@register("cost_by_model", L + f"""SELECT scan_id, key AS model, CAST(sum(cost_nano) AS BIGINT) AS cost_nano,
  CAST(floor((sum(cost_nano) + 50000) / 100000) AS DOUBLE) / 10000.0 AS cost_usd FROM cc GROUP BY scan_id, key""")
def q_cost_model(spark, sf):
    from auditlens.operators.ledger import cost_by_model
    return cost_by_model(_costs(spark, sf)).withColumn("cost_nano", F.col("cost_nano").cast("bigint"))


@register("file_cost_lookup", L + """,
f AS (SELECT c_custkey, c_custkey % 10 AS scan_id, 'src/u' || CAST(c_custkey AS STRING) || '.py' AS file_path FROM customer),
per AS (SELECT scan_id, file_path, sum(cost_nano) AS s FROM cc GROUP BY ALL)
SELECT f.c_custkey, f.scan_id, f.file_path, CAST(coalesce(per.s, 0) AS BIGINT) AS cost_nano FROM f LEFT JOIN per USING (scan_id, file_path)""")
def q_file_lookup(spark, sf):
    from auditlens.operators.ledger import file_cost_lookup
    cust = table(spark, sf, "customer")
    files = cust.select("c_custkey", (F.col("c_custkey") % 10).alias("scan_id"),
                        F.concat(F.lit("src/u"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("file_path"))
    return file_cost_lookup(files, _costs(spark, sf))


@register("cost_summary", L + f"""SELECT scan_id, CAST(sum(cost_nano) AS BIGINT) AS cost_nano,
  CAST(floor((sum(cost_nano) + 50000) / 100000) AS DOUBLE) / 10000.0 AS total_cost_usd,
  CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
  CAST(sum(input_tokens) + sum(output_tokens) AS BIGINT) AS total_tokens, count(*) AS api_calls,
  CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts)) + 50000) / 100000) AS DOUBLE) / 10.0 AS elapsed_seconds,
  min(ts) AS start_time FROM cc GROUP BY scan_id""")
def q_cost_summary(spark, sf):
    from auditlens.operators.ledger import cost_summary
    s = cost_summary(_costs(spark, sf))
    return s.select("scan_id", F.col("cost_nano").cast("bigint").alias("cost_nano"), "total_cost_usd",
                    "total_input_tokens", "total_output_tokens", "total_tokens", "api_calls",
                    "elapsed_seconds", "start_time")


@register("restore_ledger", L + """SELECT scan_id, count(*) AS n_calls, CAST(sum(cost_nano) AS BIGINT) AS cost_nano,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM cc GROUP BY scan_id""")
def q_restore(spark, sf):
    from auditlens.operators.ledger import restore_ledger
    c = _costs(spark, sf)
    prior = c.filter((F.col("call_type") == "initial") | F.col("file_path").isNull())
    new = c.filter((F.col("call_type") != "initial") | F.col("file_path").isNull())  # overlaps prior on replayed calls
    r = restore_ledger(prior, new)
    return r.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("cost_nano").cast("bigint").alias("cost_nano"),
                                    F.sum("input_tokens").cast("bigint").alias("input_tokens"))


@register("budget_gate", L + f""",
fl AS (SELECT scan_id, file_path, min(seq) AS first_seq, sum(cost_nano) AS file_nano FROM cc WHERE file_path IS NOT NULL GROUP BY ALL
  UNION ALL SELECT scan_id, file_path, seq, cost_nano FROM cc WHERE file_path IS NULL),
r AS (SELECT *, CAST(coalesce(sum(file_nano) OVER (PARTITION BY scan_id ORDER BY first_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_before_nano FROM fl)
SELECT scan_id, file_path, first_seq, spent_before_nano, spent_before_nano < {NANO(BUDGET)} AS admitted FROM r WHERE file_path IS NOT NULL""")
def q_budget_gate(spark, sf):
    from auditlens.operators.ledger import budget_gate
    return budget_gate(_costs(spark, sf), BUDGET).select("scan_id", "file_path", "first_seq", "spent_before_nano", "admitted")


_RUN = "CAST(sum(cost_nano) OVER (PARTITION BY scan_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)"


@register("budget_warning", L + f""",
r AS (SELECT scan_id, seq, {_RUN} AS running_nano FROM cc),
f AS (SELECT scan_id, min(seq) AS seq FROM r WHERE running_nano >= {NANO(BUDGET * 0.8)} GROUP BY scan_id)
SELECT f.scan_id, f.seq, r.running_nano, CAST((r.running_nano * 2000 + {NANO(BUDGET)}) // {2 * NANO(BUDGET)} AS DOUBLE) / 10.0 AS pct
FROM f JOIN r USING (scan_id, seq)""")
def q_budget_warning(spark, sf):
    from auditlens.operators.ledger import budget_warning
    return budget_warning(_costs(spark, sf), BUDGET)


@register("remaining_budget", L + f"""SELECT call_id, scan_id, seq, running_nano, greatest(0, {NANO(BUDGET)} - running_nano) AS remaining_nano
FROM (SELECT call_id, scan_id, seq, {_RUN} AS running_nano FROM cc)""")
def q_remaining(spark, sf):
    from auditlens.operators.ledger import remaining_budget
    return remaining_budget(_costs(spark, sf), BUDGET).select("call_id", "scan_id", "seq", "running_nano",
                                                              F.col("remaining_nano").cast("bigint").alias("remaining_nano"))


_FRUN = "sum(cost_nano) OVER (PARTITION BY scan_id, file_path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@register("file_cost_limit", L + f""",
r AS (SELECT scan_id, file_path, seq, CAST({_FRUN} AS BIGINT) AS fr FROM cc WHERE file_path IS NOT NULL)
SELECT scan_id, file_path, min(seq) AS stop_seq, arg_min(fr, seq) AS cost_nano FROM r WHERE fr >= {NANO(FILE_LIMIT)} GROUP BY ALL""")
def q_file_limit(spark, sf):
    from auditlens.operators.ledger import file_cost_limit
    return file_cost_limit(_costs(spark, sf), FILE_LIMIT).withColumn("cost_nano", F.col("cost_nano").cast("bigint"))


_ITER = f""",
r AS (SELECT scan_id, file_path, seq, call_type, cost_nano, CAST({_FRUN} AS BIGINT) AS fr FROM cc WHERE file_path IS NOT NULL),
v AS (SELECT scan_id, file_path, seq, fr AS iter_nano FROM r WHERE starts_with(call_type, 'secondary'))"""


@register("iteration_cost_limit", L + _ITER + f"""
SELECT scan_id, file_path, min(seq) AS stop_seq FROM v WHERE iter_nano >= {NANO(ITER_LIMIT)} GROUP BY ALL""")
def q_iter_limit(spark, sf):
    from auditlens.operators.ledger import iteration_cost_limit
    return iteration_cost_limit(_costs(spark, sf), ITER_LIMIT)


@register("escalation_stop", L + _ITER + """,
e AS (SELECT *, lag(iter_nano, 2) OVER w AS a, lag(iter_nano, 1) OVER w AS b FROM v WINDOW w AS (PARTITION BY scan_id, file_path ORDER BY seq))
SELECT scan_id, file_path, min(seq) AS stop_seq FROM e WHERE a IS NOT NULL AND a * 5 < b * 4 AND b * 5 < iter_nano * 4 GROUP BY ALL""")
def q_escalation(spark, sf):
    from auditlens.operators.ledger import escalation_stop
    return escalation_stop(_costs(spark, sf))


@register("escalation_stop_delta", L + _ITER.replace("fr AS iter_nano", "cost_nano AS iter_nano") + """,
e AS (SELECT *, lag(iter_nano, 2) OVER w AS a, lag(iter_nano, 1) OVER w AS b FROM v WINDOW w AS (PARTITION BY scan_id, file_path ORDER BY seq))
SELECT scan_id, file_path, min(seq) AS stop_seq FROM e WHERE a IS NOT NULL AND a * 5 < b * 4 AND b * 5 < iter_nano * 4 GROUP BY ALL""")
def q_escalation_delta(spark, sf):
    from auditlens.operators.ledger import escalation_stop
    return escalation_stop(_costs(spark, sf), mode="delta")


_EST = f"""WITH e AS (SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS t FROM documents),
x AS (SELECT doc_id, t AS file_tokens, CAST((27 * t + 143501) // 2 AS BIGINT) AS estimated_input_tokens FROM e),
y AS (SELECT *, CAST(estimated_input_tokens * 250 + 33250 * 1250 AS BIGINT) AS cost_nano FROM x)"""


@register("estimate_file_costs", _EST + f"""
SELECT doc_id, file_tokens, estimated_input_tokens, CAST(33250 AS BIGINT) AS estimated_output_tokens,
  estimated_input_tokens + 33250 AS estimated_total_tokens, CAST(14 AS BIGINT) AS estimated_calls, cost_nano,
  {R4} AS estimated_cost_usd FROM y""")
def q_estimate(spark, sf):
    from auditlens.operators.ledger import estimate_file_costs
    e = estimate_file_costs(table(spark, sf, "documents").select("doc_id", "text"), EST_MODEL, content_col="text")
    return e.drop("text")


@register("estimate_corpus_cost", _EST + """,
u AS (SELECT CAST(floor(doc_id / 50) AS BIGINT) AS grp, count(*) AS file_count, CAST(sum(estimated_input_tokens) AS BIGINT) AS estimated_input_tokens,
      CAST(sum(33250) AS BIGINT) AS estimated_output_tokens, CAST(sum(floor((cost_nano + 50000) / 100000)) AS BIGINT) + 100 AS units FROM y GROUP BY 1)
SELECT grp, file_count, estimated_input_tokens, estimated_output_tokens, estimated_input_tokens + estimated_output_tokens AS estimated_total_tokens,
  CAST(units AS DOUBLE) / 10000.0 AS estimated_cost_usd, CAST((units + 1) // 2 AS DOUBLE) / 10000.0 AS low_usd,
  CAST((3 * units + 1) // 2 AS DOUBLE) / 10000.0 AS high_usd FROM u""")
def q_estimate_corpus(spark, sf):
    from auditlens.operators.ledger import estimate_corpus_cost, estimate_file_costs
    docs = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 50).cast("bigint").alias("grp"), "text")
    return estimate_corpus_cost(estimate_file_costs(docs, EST_MODEL, content_col="text"), by=("grp",))
