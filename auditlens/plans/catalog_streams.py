"""Registered queries: streaming jobs, checked against their batch answers.

Each run lands the input table in several drops in a fresh folder under the
session's checkpoint folder.  After each drop the stream is started over the same
checkpoint and runs until it has caught up (availableNow), so restarts and state
carry-over happen; the query returns what the sink holds.  A drop is written
with the partitions that its rows have, many files to a drop.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditlens.plans import oracle as O
from auditlens.plans.catalog import register
from auditlens.plans.catalog_ledger import BUDGET, L, NANO
from auditlens.session import checkpoint_dir
from auditlens.sources.tables import fixture, with_fixtures


def _run_dir(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:10]}"


@register("stream_incremental_scan", with_fixtures("fx_files") + f"""
SELECT repo_id, path FROM fx_files WHERE {O.keep_path_sql('path')} AND {O.network_sql('content')}""")
def q_stream_scan(spark, sf):
    from auditlens.streaming.streams import stream_incremental_scan
    base = _run_dir(spark, "scan")
    files = fixture(spark, sf, "fx_files").select("repo_id", "path", "content")

    def run():
        stream_incremental_scan(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", files.schema).awaitTermination()

    for i in range(2):
        files.filter(F.pmod(F.xxhash64("repo_id", "path"), F.lit(2)) == i).write.mode("append").parquet(f"{base}/in")
        run()
    run()  # nothing new: must not reprocess anything
    return spark.read.parquet(f"{base}/out").select("repo_id", "path")


def _calls_drops(spark, sf, base, run, drops: int = 4):
    """Land the call ledger in seq order, drop by drop, and let ``run(stream)`` catch up after each."""
    calls = fixture(spark, sf, "fx_calls")
    top = calls.agg(F.max("seq").alias("_top"))  # one row
    dealt = calls.crossJoin(F.broadcast(top)).withColumn("_drop", F.floor((F.col("seq") - 1) * drops / F.col("_top")))
    for i in range(drops):
        dealt.filter(F.col("_drop") == i).drop("_top", "_drop").write.mode("append").parquet(f"{base}/in")
        run(spark.readStream.schema(calls.schema).parquet(f"{base}/in")).awaitTermination()


@register("stream_cost_totals", L + """SELECT scan_id, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cost_nano) AS BIGINT) AS cost_nano FROM cc GROUP BY scan_id""")
def q_stream_totals(spark, sf):
    from auditlens.streaming.streams import read_totals, stream_cost_totals, write_totals
    base = _run_dir(spark, "totals")
    _calls_drops(spark, sf, base, lambda s: write_totals(stream_cost_totals(s), f"{base}/out", f"{base}/ckpt"))
    return read_totals(spark, f"{base}/out").select("scan_id", "calls", *[F.col(c).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens", "cost_nano")])


_RUN = "CAST(sum(cost_nano) OVER (PARTITION BY scan_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)"


@register("stream_budget_alerts", L + f""",
r AS (SELECT scan_id, seq, {_RUN} AS running_nano FROM cc),
w AS (SELECT scan_id, 'warning' AS kind, min(seq) AS seq FROM r WHERE running_nano >= {NANO(BUDGET * 0.8)} GROUP BY scan_id
      UNION ALL SELECT scan_id, 'exceeded', min(seq) FROM r WHERE running_nano >= {NANO(BUDGET)} GROUP BY scan_id)
SELECT w.scan_id, w.kind, w.seq, r.running_nano FROM w JOIN r USING (scan_id, seq)""")
def q_stream_alerts(spark, sf):
    from auditlens.streaming.streams import stream_budget_alerts
    base = _run_dir(spark, "alerts")
    _calls_drops(spark, sf, base, lambda s: stream_budget_alerts(s, BUDGET, f"{base}/out", f"{base}/ckpt"))
    return spark.read.parquet(f"{base}/out").drop("epoch")
