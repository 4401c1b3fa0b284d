"""Model-call ledger: pricing, exact costs, rollups, budget windows, estimates.

Money is carried as exact integer nano-USD (tokens x nano-USD per token);
every per-token price in the price list is an integer number of nano-USD,
so sums are exact and engine-independent.  Doubles appear only in the last
projection.  Running totals use a two-level prefix sum so one giant scan
never lands in a single window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens.functions import dims
from auditlens.functions.slices import prefix_sum
from auditlens.functions.text import nano_round4, nano_to_usd



def pricing_key(model: Column) -> Column:
    """Provider prefix dropped: 'openai/gpt-4o' → 'gpt-4o'."""
    return F.regexp_replace(model, r"^[^/]*/", "")


def provider_of(model: Column) -> Column:
    lo = F.lower(model)
    return (F.when(lo.startswith("anthropic/") | lo.contains("claude"), F.lit("anthropic"))
            .when(lo.startswith("openai/") | lo.contains("gpt"), F.lit("openai"))
            .when(lo.startswith("ollama/"), F.lit("ollama"))
            .otherwise(F.lit("unknown")))


def resolve_pricing(models: DataFrame, model_col: str = "key") -> DataFrame:
    """Distinct model names → (key, in_nano, out_nano, match).

    exact name → first table entry (in order) containing or contained in the
    name, case-insensitively → provider fallbacks → default.  Runs on the
    distinct names only: a broadcast nested-loop against the 16-row price
    list, then ``min_by`` on (tier, order).
    """
    spark = models.sparkSession
    keys = models.select(F.col(model_col).alias("key")).distinct()
    pr = F.broadcast(dims.pricing_dim(spark))
    lk, lm = F.lower(F.col("key")), F.lower(F.col("model"))
    tier = F.when(F.col("key") == F.col("model"), F.lit(0)).otherwise(F.lit(1))
    cand = (keys.join(pr, (F.col("key") == F.col("model")) | lm.contains(lk) | lk.contains(lm), "left")
            .groupBy("key")
            .agg(F.min_by(F.struct("in_nano", "out_nano", tier.alias("tier")),
                          tier * F.lit(1000) + F.col("ord")).alias("_m")))
    price = {m: (int(round(a * 1e6)), int(round(b * 1e6))) for m, a, b in dims.PRICING}
    fin, fout = F.lit(int(round(dims.DEFAULT_PRICE[0] * 1e6))), F.lit(int(round(dims.DEFAULT_PRICE[1] * 1e6)))
    fmatch = F.lit("default")
    for sub, entry in reversed(dims.PRICE_FALLBACKS):
        hit = F.lower(F.col("key")).contains(sub)
        fin = F.when(hit, F.lit(price[entry][0])).otherwise(fin)
        fout = F.when(hit, F.lit(price[entry][1])).otherwise(fout)
        fmatch = F.when(hit, F.lit("provider")).otherwise(fmatch)
    found = F.col("_m").isNotNull() & F.col("_m.in_nano").isNotNull()
    return cand.select(
        "key",
        F.when(found, F.col("_m.in_nano")).otherwise(fin).cast("bigint").alias("in_nano"),
        F.when(found, F.col("_m.out_nano")).otherwise(fout).cast("bigint").alias("out_nano"),
        F.when(found & (F.col("_m.tier") == 0), F.lit("exact"))
         .when(found, F.lit("partial")).otherwise(fmatch).alias("match"))


def price_expr(key: Column) -> Column:
    """Price resolution as one expression over the fixed price list:
    exact → first partial (either containment, case-insensitive) in table
    order → provider fallbacks → default.  A model's price is a pure function
    of its name, so per-row resolution needs no join, no shuffle and no
    extra job (and works on streams)."""
    nano = {m: (int(round(a * 1e6)), int(round(b * 1e6))) for m, a, b in dims.PRICING}
    mk = lambda i, o: F.struct(F.lit(i).cast("bigint").alias("in_nano"), F.lit(o).cast("bigint").alias("out_nano"))
    out = mk(int(round(dims.DEFAULT_PRICE[0] * 1e6)), int(round(dims.DEFAULT_PRICE[1] * 1e6)))
    lk = F.lower(key)
    for sub, entry in reversed(dims.PRICE_FALLBACKS):
        out = F.when(lk.contains(sub), mk(*nano[entry])).otherwise(out)
    for m, _, _ in reversed(dims.PRICING):
        out = F.when(F.lit(m.lower()).contains(lk) | lk.contains(m.lower()), mk(*nano[m])).otherwise(out)
    for m, _, _ in reversed(dims.PRICING):
        out = F.when(key == m, mk(*nano[m])).otherwise(out)
    return out


def call_costs(calls: DataFrame, model_col: str = "model", prices: DataFrame | None = None) -> DataFrame:
    """Add ``key`` (pricing name), prices and exact ``cost_nano`` per call.

    With the fixed price list the price is the ``price_expr`` projection
    (map-only); a user price table (``prices``: key, in_nano, out_nano, e.g.
    from ``resolve_pricing`` over another list) is joined instead, by the plan
    that its size calls for.
    """
    c = calls.withColumn("key", pricing_key(F.col(model_col)))
    if prices is not None:
        return (c.join(prices.select("key", "in_nano", "out_nano"), "key", "left")
                .withColumn("cost_nano", F.col("input_tokens") * F.col("in_nano") + F.col("output_tokens") * F.col("out_nano")))
    p = price_expr(F.col("key"))
    return (c.withColumn("in_nano", p["in_nano"]).withColumn("out_nano", p["out_nano"])
            .withColumn("cost_nano", F.col("input_tokens") * F.col("in_nano") + F.col("output_tokens") * F.col("out_nano")))


def usage_by_provider(calls: DataFrame, model_col: str = "model") -> DataFrame:
    return (calls.groupBy(provider_of(F.col(model_col)).alias("provider"))
            .agg(F.count(F.lit(1)).alias("calls"),
                 F.sum("input_tokens").cast("bigint").alias("input_tokens"),
                 F.sum("output_tokens").cast("bigint").alias("output_tokens")))


def cost_by_file(costs: DataFrame, by=("scan_id",)) -> DataFrame:
    """Per file (null/empty file paths excluded), cost rounded to 4 decimals."""
    return (costs.filter(F.col("file_path").isNotNull() & (F.col("file_path") != ""))
            .groupBy(*by, "file_path").agg(F.sum("cost_nano").alias("cost_nano"))
            .withColumn("cost_usd", nano_round4(F.col("cost_nano"))))


def cost_by_model(costs: DataFrame, by=("scan_id",)) -> DataFrame:
    return (costs.groupBy(*by, F.col("key").alias("model")).agg(F.sum("cost_nano").alias("cost_nano"))
            .withColumn("cost_usd", nano_round4(F.col("cost_nano"))))


def file_cost_lookup(files: DataFrame, costs: DataFrame, by=("scan_id",), path_col: str = "file_path") -> DataFrame:
    """Cost of the given files; 0 when a file has no calls."""
    per = costs.groupBy(*by, "file_path").agg(F.sum("cost_nano").alias("_c"))
    return (files.join(per, [*by, "file_path"] if path_col == "file_path" else
                       [*[files[b] == per[b] for b in by], files[path_col] == per["file_path"]], "left")
            .withColumn("cost_nano", F.coalesce(F.col("_c"), F.lit(0)).cast("bigint")).drop("_c"))


def cost_summary(costs: DataFrame, by=("scan_id",), with_model_map: bool = False) -> DataFrame:
    """Totals per scan; elapsed is max(ts) - min(ts) in seconds (1 decimal).

    ``with_model_map`` adds ``costs_by_model`` (model → USD, 4 decimals): a
    map over the scan's few models.  Per-file costs stay the
    ``cost_by_file`` table - a map of every file of a scan would gather an
    unbounded group into one value.
    """
    out = (costs.groupBy(*by).agg(
        F.sum("cost_nano").alias("cost_nano"),
        F.sum("input_tokens").cast("bigint").alias("total_input_tokens"),
        F.sum("output_tokens").cast("bigint").alias("total_output_tokens"),
        F.count(F.lit(1)).alias("api_calls"),
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
        .withColumn("total_cost_usd", nano_round4(F.col("cost_nano")))
        .withColumn("total_tokens", F.col("total_input_tokens") + F.col("total_output_tokens"))
        .withColumn("elapsed_seconds", F.floor(
            (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))
             + F.lit(50000)) / F.lit(100000)).cast("double") / F.lit(10.0)))
    if with_model_map:
        m = (cost_by_model(costs, by).groupBy(*by)
             .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "cost_usd")))).alias("costs_by_model")))
        out = out.join(m, list(by), "left")
    return out


def restore_ledger(prior: DataFrame, new: DataFrame, key: str = "call_id") -> DataFrame:
    """Prior ∪ new calls, idempotent by call id (a replayed call counts once)."""
    return prior.unionByName(new, allowMissingColumns=True).dropDuplicates([key])


# ---------------------------------------------------------------------------
# Running totals
# ---------------------------------------------------------------------------

def budget_gate(costs: DataFrame, budget_usd: float | None, by=("scan_id",), order: str = "seq") -> DataFrame:
    """Per file in file order (first call): spent before it and admitted.

    ``order`` is any sortable column that is unique in a scan - a dense or
    sparse number, a timestamp; one hot scan is cut at quantiles of it.

    A file is admitted iff the total spent before it is below the budget: the
    cost of all earlier files and of every call without a file made before
    its first call.  Costs are non-negative, so the prefix is monotone and
    the gate never reopens.  No budget admits everything.
    """
    files = (costs.filter(F.col("file_path").isNotNull())
             .groupBy(*by, "file_path").agg(F.min(order).alias("first_seq"), F.sum("cost_nano").alias("file_nano")))
    other = costs.filter(F.col("file_path").isNull()).select(*by, "file_path", F.col(order).alias("first_seq"), F.col("cost_nano").alias("file_nano"))
    out = (prefix_sum(files.unionByName(other), by, "first_seq", "file_nano", "spent_before_nano", inclusive=False)
           .filter(F.col("file_path").isNotNull()))
    adm = F.lit(True) if budget_usd is None else F.col("spent_before_nano") < F.lit(int(round(budget_usd * 1e9)))
    return out.withColumn("admitted", adm)


def running_cost(costs: DataFrame, by=("scan_id",), order: str = "seq") -> DataFrame:
    return prefix_sum(costs, by, order, "cost_nano", "running_nano", inclusive=True)


def budget_warning(costs: DataFrame, budget_usd: float, threshold: float = 0.8, by=("scan_id",), order: str = "seq") -> DataFrame:
    """First call per scan, in ``order``, whose running total reaches threshold x budget."""
    thr = int(round(budget_usd * 1e9 * threshold))
    r = running_cost(costs, by, order).filter(F.col("running_nano") >= F.lit(thr))
    first = r.groupBy(*by).agg(F.min_by(F.struct(F.col(order).alias("seq"), "running_nano"), F.col(order)).alias("_f"))
    b = int(round(budget_usd * 1e9))
    # percentage to one decimal, half up, in integers
    pct = F.expr(f"(_f.running_nano * 2000 + {b}) div {2 * b}").cast("double") / F.lit(10.0)
    return first.select(*by, F.col("_f.seq").alias("seq"), F.col("_f.running_nano").alias("running_nano"),
                        pct.alias("pct"))


def remaining_budget(costs: DataFrame, budget_usd: float | None, by=("scan_id",), order: str = "seq") -> DataFrame:
    r = running_cost(costs, by, order)
    if budget_usd is None:
        return r.withColumn("remaining_nano", F.lit(None).cast("bigint"))
    return r.withColumn("remaining_nano", F.greatest(F.lit(0), F.lit(int(round(budget_usd * 1e9))) - F.col("running_nano")))


def _file_running(costs: DataFrame, by) -> DataFrame:
    w = Window.partitionBy(*by, "file_path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return costs.filter(F.col("file_path").isNotNull()).withColumn("file_running_nano", F.sum("cost_nano").over(w))


def file_cost_limit(costs: DataFrame, limit_usd: float, by=("scan_id",)) -> DataFrame:
    """Per file: first call at which the file's running cost reaches the limit."""
    lim = int(round(limit_usd * 1e9))
    r = _file_running(costs, by).filter(F.col("file_running_nano") >= lim)
    return (r.groupBy(*by, "file_path")
            .agg(F.min_by(F.struct("seq", "file_running_nano"), F.col("seq")).alias("_f"))
            .select(*by, "file_path", F.col("_f.seq").alias("stop_seq"), F.col("_f.file_running_nano").alias("cost_nano")))


def iteration_values(costs: DataFrame, mode: str = "cumulative", by=("scan_id",)) -> DataFrame:
    """The value handed to the iteration check at each secondary call:
    the file's cumulative cost (the audited workflow's behaviour) or the
    call's own cost (``mode='delta'``)."""
    r = _file_running(costs, by).filter(F.col("call_type").startswith("secondary"))
    return r.withColumn("iter_nano", F.col("file_running_nano") if mode == "cumulative" else F.col("cost_nano"))


def iteration_cost_limit(costs: DataFrame, limit_usd: float, mode: str = "cumulative", by=("scan_id",)) -> DataFrame:
    lim = int(round(limit_usd * 1e9))
    r = iteration_values(costs, mode, by).filter(F.col("iter_nano") >= lim)
    return (r.groupBy(*by, "file_path").agg(F.min("seq").alias("stop_seq")))


def escalation_stop(costs: DataFrame, mode: str = "cumulative", factor: tuple[int, int] = (4, 5),
                    by=("scan_id",)) -> DataFrame:
    """First iteration where each of the last three values is below factor x
    the next (factor 0.8 = 4/5, compared in integers: 5a < 4b)."""
    num, den = factor
    v = iteration_values(costs, mode, by)
    w = Window.partitionBy(*by, "file_path").orderBy("seq")
    a, b, c = F.lag("iter_nano", 2).over(w), F.lag("iter_nano", 1).over(w), F.col("iter_nano")
    esc = a.isNotNull() & (a * den < b * num) & (b * den < c * num)
    return (v.withColumn("_esc", esc).filter("_esc")
            .groupBy(*by, "file_path").agg(F.min("seq").alias("stop_seq")))


# ---------------------------------------------------------------------------
# Estimates
# ---------------------------------------------------------------------------

def estimate_file_costs(files: DataFrame, model: str, content_col: str = "content") -> DataFrame:
    """Dry-run estimate per file (planning model, exact integer arithmetic).

    tokens t = ceil(len/4); input = round(t + 3000 + (t + 5500) x 12.5)
    = (27 t + 143501) div 2; output = 33250; calls = 14.
    """
    p = price_expr(F.lit(model))  # constant-folded by the optimizer
    secondary = dims.EST_TYPES_PER_FILE * dims.EST_ITERATIONS_PER_TYPE  # 12.5
    ctx = dims.EST_CONTEXT_PER_ITERATION * (dims.EST_ITERATIONS_PER_TYPE / 2)  # 2500
    t = F.ceil(F.length(F.col(content_col)) / F.lit(4)).cast("bigint")
    # round(t + O + (t + O + ctx) * s) with s = 12.5: twice the value is an integer
    twice = F.lit(2) * t + F.lit(2 * dims.EST_PROMPT_OVERHEAD) + F.lit(int(2 * secondary)) * (t + F.lit(int(dims.EST_PROMPT_OVERHEAD + ctx)))
    inp = F.floor((twice + F.lit(1)) / F.lit(2)).cast("bigint")
    out_tokens = int(round(dims.EST_INITIAL_OUTPUT + dims.EST_SECONDARY_OUTPUT * secondary))
    calls = int(1 + secondary + 0.5)  # round(13.5) = 14
    return (files.withColumn("in_nano", p["in_nano"]).withColumn("out_nano", p["out_nano"])
            .withColumn("file_tokens", t)
            .withColumn("estimated_input_tokens", inp)
            .withColumn("estimated_output_tokens", F.lit(out_tokens).cast("bigint"))
            .withColumn("estimated_total_tokens", inp + F.lit(out_tokens))
            .withColumn("estimated_calls", F.lit(calls).cast("bigint"))
            .withColumn("cost_nano", inp * F.col("in_nano") + F.lit(out_tokens) * F.col("out_nano"))
            .withColumn("estimated_cost_usd", nano_round4(F.col("cost_nano")))
            .drop("in_nano", "out_nano"))


def estimate_corpus_cost(estimates: DataFrame, by=()) -> DataFrame:
    """Sum of per-file 4-decimal costs + README overhead; range x0.5 .. x1.5.

    Worked in units of 1e-4 USD so every rounding is exact (half up).
    """
    units = F.floor((F.col("cost_nano") + F.lit(50000)) / F.lit(100000)).cast("bigint")
    overhead = int(round(dims.EST_README_OVERHEAD_USD * 1e4))
    g = estimates.groupBy(*by) if by else estimates.groupBy()
    agg = g.agg(F.count(F.lit(1)).alias("file_count"),
                F.sum("estimated_input_tokens").cast("bigint").alias("estimated_input_tokens"),
                F.sum("estimated_output_tokens").cast("bigint").alias("estimated_output_tokens"),
                F.sum(units).alias("_u"))
    u = F.coalesce(F.col("_u"), F.lit(0)) + F.lit(overhead)
    return (agg.withColumn("estimated_total_tokens", F.col("estimated_input_tokens") + F.col("estimated_output_tokens"))
            .withColumn("estimated_cost_usd", u.cast("double") / F.lit(1e4))
            .withColumn("low_usd", F.floor((u + F.lit(1)) / F.lit(2)).cast("double") / F.lit(1e4))
            .withColumn("high_usd", F.floor((F.lit(3) * u + F.lit(1)) / F.lit(2)).cast("double") / F.lit(1e4))
            .drop("_u"))


def usd(c: Column) -> Column:
    return nano_to_usd(c)
