"""Structured Streaming jobs for the three live behaviours.

* ``stream_incremental_scan``: new source files are discovered and turned
  into prompts exactly once across restarts (file-source offsets live in
  the checkpoint); each micro-batch runs the batch operators.
* ``stream_cost_totals``: running totals per key as calls arrive (stateful
  aggregation; prices resolved by a pure expression, no join), kept as the
  changed keys of each epoch.
* ``stream_budget_alerts``: once-only 80 % warning and exceeded signal per
  scan; running totals of a batch are a sliced prefix sum on top of the
  totals of earlier epochs, without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.functions.slices import prefix_sum
from auditlens.operators.ledger import price_expr, pricing_key
from auditlens.streaming.epochs import MERGE_EVERY, epoch_writer, merge_epochs, read_newest, write_epoch


def with_cost(calls: DataFrame, model_col: str = "model") -> DataFrame:
    p = price_expr(pricing_key(F.col(model_col)))
    return (calls.withColumn("key", pricing_key(F.col(model_col))).withColumn("_p", p)
            .withColumn("cost_nano", F.col("input_tokens") * F.col("_p.in_nano") + F.col("output_tokens") * F.col("_p.out_nano"))
            .drop("_p"))


# ---------------------------------------------------------------------------
# Incremental scan
# ---------------------------------------------------------------------------

def stream_incremental_scan(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema,
                            available_now: bool = True, max_files_per_trigger: int | None = None):
    """Discover + build initial prompts for files as they land; each file once."""
    from auditlens.operators.paths import discover_files
    from auditlens.operators.prompts import build_initial_prompts

    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = reader.parquet(in_dir)

    def batch(df: DataFrame, epoch_id: int) -> None:
        d = discover_files(df.select("repo_id", "path", "content"))
        # a batch that is run again after a failure replaces its own folder
        build_initial_prompts(d).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/epoch={epoch_id}")

    w = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# ---------------------------------------------------------------------------
# Running totals
# ---------------------------------------------------------------------------

def stream_cost_totals(stream_calls: DataFrame, keys=("scan_id",)) -> DataFrame:
    """Streaming aggregate: calls, tokens and exact cost per key."""
    c = with_cost(stream_calls)
    return c.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"),
                                F.sum("input_tokens").alias("input_tokens"),
                                F.sum("output_tokens").alias("output_tokens"),
                                F.sum("cost_nano").alias("cost_nano"))


def write_totals(totals: DataFrame, out_dir: str, checkpoint: str, keys=("scan_id",), available_now: bool = True):
    """Keep the totals of ``stream_cost_totals``: a micro-batch writes the keys that it changed, in update mode.

    ``read_totals`` gives the current table; the folder is never rewritten as a whole.
    """
    w = (totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(epoch_writer(out_dir, list(keys))))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_totals(spark: SparkSession, out_dir: str, keys=("scan_id",)) -> DataFrame | None:
    """Newest totals per key (None before the first epoch)."""
    found = read_newest(spark, out_dir, list(keys))
    return found if found is None else found.drop("epoch")


# ---------------------------------------------------------------------------
# Budget alerts
# ---------------------------------------------------------------------------

def alert_batch(calls: DataFrame, epoch: int, out_dir: str, state_dir: str, budget_usd: float, threshold: float = 0.8,
                key: str = "scan_id", merge_every: int = MERGE_EVERY) -> None:
    """One micro-batch of ``stream_budget_alerts``; running it again changes nothing.

    State per scan is its total and two flags.  The batch's running totals are
    a sliced prefix sum, so neither a scan nor the batch is gathered anywhere;
    the state as it was before this epoch is added to them.
    """
    spark = calls.sparkSession
    budget = int(round(budget_usd * 1e9))
    limits = {"warning": int(round(budget_usd * 1e9 * threshold)), "exceeded": budget}
    empty = spark.createDataFrame([], calls.select(key).schema).select(
        key, F.lit(0).cast("bigint").alias("total_nano"), *[F.lit(False).alias(k) for k in limits])
    state = read_newest(spark, state_dir, [key], before=epoch)
    state = (empty if state is None else state.drop("epoch")).withColumnRenamed(key, "_key")
    run = prefix_sum(with_cost(calls).select(key, F.col("seq").cast("long").alias("seq"), F.col("cost_nano").cast("long").alias("cost_nano")),
                     [key], "seq", "cost_nano", "_run")
    seen = run.groupBy(key).agg(F.sum("cost_nano").alias("_new"))
    now = (seen.join(state, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
           .withColumn("_old", F.coalesce("total_nano", F.lit(0))))
    for kind in limits:
        now = now.withColumn(kind, F.coalesce(kind, F.lit(False)))
    before = now.select(F.col(key).alias("_key"), "_old", *limits)
    running = run.join(before, F.col(key).eqNullSafe(F.col("_key"))).withColumn("running_nano", F.col("_run") + F.col("_old"))
    crossed = [running.where(~F.col(kind) & (F.col("running_nano") >= limit)).groupBy(key)
               .agg(F.min_by(F.struct("seq", "running_nano"), "seq").alias("_f"))
               .select(key, F.lit(kind).alias("kind"), "_f.seq", "_f.running_nano") for kind, limit in limits.items()]
    crossed[0].unionByName(crossed[1]).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/epoch={epoch}")
    total = F.col("_old") + F.col("_new")
    # costs are not negative, so the total at the end of the batch says whether a limit was met
    write_epoch(now.select(key, total.cast("bigint").alias("total_nano"), *[(F.col(k) | (total >= v)).alias(k) for k, v in limits.items()]), state_dir, epoch)
    if epoch and epoch % merge_every == 0:
        merge_epochs(spark, state_dir, [key], epoch)


def stream_budget_alerts(stream_calls: DataFrame, budget_usd: float, out_dir: str, checkpoint: str, threshold: float = 0.8,
                         key: str = "scan_id", available_now: bool = True):
    """Once-only 'warning' (running >= threshold x budget) and 'exceeded'
    (running >= budget) per scan, in call order (seq) within each batch.

    Alerts (key, kind, seq, running_nano) land under ``out_dir``; the state of
    the scans, three values each, beside the checkpoint.
    """
    state_dir = f"{checkpoint.rstrip('/')}-state"
    w = stream_calls.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, epoch: alert_batch(df, epoch, out_dir, state_dir, budget_usd, threshold, key))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
