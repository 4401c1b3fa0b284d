"""Iterative refinement over rounds, for all (file, type) pairs at once.

Round 0 scores a secondary prompt per pair with the initial reply as the
previous analysis.  Round i >= 1 stops a pair when reply i-1 asked for no
context, or (i >= 2) asked for the same sorted names or the same number of
names as reply i-2; otherwise the names are resolved against the file list,
appended to the pair's context and the pair is scored again.  A pair that stops
is written once and leaves the loop: every round writes one table in the shared
checkpoint folder, split into closed and open pairs, and the next round reads
the open ones alone, so bytes read and written fall with the open set.  The loop
ends when no pair is open (an ``isEmpty`` probe, never a collect).

With ``Limits`` a pair also stops when its repository's cost reaches the
budget, when its file's cost reaches the iteration limit, or when the file's
cost grew by more than a quarter in each of the last two rounds.  Costs are
known when a round has been scored, so they are checked before every round
for all pairs at once; a stopped pair keeps its last reply.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions.plan import cut_lineage
from auditlens.operators.ledger import price_expr, pricing_key
from auditlens.operators.prompts import build_secondary_prompts
from auditlens.operators.responses import parse_responses, repair_responses
from auditlens.operators.scoring import score_prompts
from auditlens.operators.symbols import definition_index, resolve_symbols_batch
from auditlens.session import checkpoint_dir

PAIR = ["repo_id", "path", "vuln_type"]
CTX_T = "array<struct<ord:int,name:string,requested:string,file_path:string,source:string>>"


@dataclass(frozen=True)
class Limits:
    """Cost rules of a run; costs are those of ``model`` in the price list."""
    model: str
    budget_usd: float | None = None
    iteration_usd: float | None = None
    escalation: tuple[int, int] | None = (4, 5)

    def cost(self) -> Column:
        p = price_expr(pricing_key(F.lit(self.model)))
        return (F.col("input_tokens") * p["in_nano"] + F.col("output_tokens") * p["out_nano"]).cast("bigint")

    def reason(self, repo: Column, file: Column, history: Column) -> Column:
        """Why a pair must not go on, else null; ``history`` ends with ``file``."""
        nano = lambda usd: F.lit(int(round(usd * 1e9)))
        rules = []
        if self.budget_usd is not None:
            rules.append((repo >= nano(self.budget_usd), "budget"))
        if self.iteration_usd is not None:
            rules.append((file >= nano(self.iteration_usd), "iteration_cost"))
        if self.escalation is not None:
            num, den = self.escalation
            at = lambda k: F.try_element_at(history, F.lit(k))
            rules.append((F.coalesce((at(-3) * den < at(-2) * num) & (at(-2) * den < at(-1) * num), F.lit(False)), "escalation"))
        out = F.lit(None).cast("string")
        for test, name in reversed(rules):
            out = F.when(test, F.lit(name)).otherwise(out)
        return out


def _with_costs(rows: DataFrame, spent: DataFrame) -> DataFrame:
    """Add ``_repo`` and ``_file``, the cost so far of the row's repository and file."""
    per_file = spent.groupBy("repo_id", "path").agg(F.sum("spent").alias("_file"))
    per_repo = spent.groupBy("repo_id").agg(F.sum("spent").alias("_repo"))
    return (rows.join(per_file, ["repo_id", "path"], "left").join(per_repo, "repo_id", "left")
            .withColumn("_file", F.coalesce("_file", F.lit(0))).withColumn("_repo", F.coalesce("_repo", F.lit(0))))


def _score(pairs: DataFrame, files: DataFrame, scorer, provider: str) -> DataFrame:
    """prompt → score → repair → parse for (pair, previous, ctx) rows."""
    p = build_secondary_prompts(pairs.select(*PAIR, "previous", "ctx"), files)
    scored = score_prompts(p.filter(F.col("prompt").isNotNull()), scorer, keys=PAIR)
    rep = repair_responses(scored.withColumn("provider", F.lit(provider)), text_col="raw")
    parsed, _ = parse_responses(rep.select(*PAIR, "input_tokens", "output_tokens", "error", "repaired"))
    return parsed


STATE_COLS = [*PAIR, "ok", "scratchpad", "analysis", "poc", "confidence_score", "vulnerability_types",
              "context_code", "ctx", "round", "prev_names", "stop_reason", "spent", "file_costs"]
REPLY = ["ok", "scratchpad", "analysis", "poc", "confidence_score", "vulnerability_types", "context_code"]
NO_COSTS = "array<bigint>"


def initial_state(files: DataFrame, initial: DataFrame, scorer, provider: str = "openai",
                  limits: Limits | None = None, prior: DataFrame | None = None, run_name: str | None = None) -> DataFrame:
    """Round 0: every pair scored once with the initial reply as previous
    analysis and no context (names of the initial reply are not resolved).

    A pair that the cost of earlier calls (``prior``) stops already keeps its
    initial reply, with round -1; so does one whose call failed
    ('call_failed').
    """
    run_name = run_name or f"refine/{uuid.uuid4().hex}"
    open_ = initial.select(*PAIR, "previous").withColumn("ctx", F.array().cast(CTX_T)).withColumn("file_costs", F.array().cast(NO_COSTS))

    def state(rows: DataFrame, no: int, reason: Column, spent: Column) -> DataFrame:
        return rows.select(*PAIR, *REPLY, "ctx", F.lit(no).alias("round"), F.lit(None).cast("array<string>").alias("prev_names"),
                           reason.cast("string").alias("stop_reason"), spent.cast("bigint").alias("spent"), "file_costs")

    def unchanged(rows: DataFrame) -> DataFrame:
        """``rows`` (with ``_reason``) closed with the reply they came with."""
        reply, _ = parse_responses(repair_responses(rows.select(*PAIR, "previous").withColumn("provider", F.lit(provider)), text_col="previous")
                                   .select(*PAIR, "repaired"))
        return state(reply.join(rows.select(*PAIR, "ctx", "_reason", "file_costs"), PAIR), -1, F.col("_reason"), F.lit(0))

    out = []
    if limits is not None and prior is not None:
        checked = _with_costs(open_, prior).withColumn("file_costs", F.array("_file").cast(NO_COSTS))
        checked = checked.withColumn("_reason", limits.reason(F.col("_repo"), F.col("_file"), F.col("file_costs")))
        out.append(unchanged(checked.filter("_reason IS NOT NULL")))
        open_ = checked.filter("_reason IS NULL").drop("_reason")
    scored = cut_lineage(_score(open_.select(*PAIR, "previous", "ctx"), files, scorer, provider), f"{run_name}/scored")
    failed = open_.join(scored.filter("error IS NOT NULL").select(*PAIR), PAIR).withColumn("_reason", F.lit("call_failed"))
    good = scored.filter("error IS NULL").join(open_.select(*PAIR, "ctx", "file_costs"), PAIR)
    result = state(good, 0, F.lit(None), limits.cost() if limits else F.lit(0)).unionByName(unchanged(failed))
    return result.unionByName(out[0]) if out else result


def refine_round(open_: DataFrame, files: DataFrame, scorer, round_no: int, provider: str = "openai",
                 defs: DataFrame | None = None, limits: Limits | None = None,
                 closed_costs: DataFrame | None = None) -> DataFrame:
    """One round for the open pairs: stop pairs whose last reply
    asked for nothing / the same names / the same count as the one before;
    resolve the others' requested names against the file list (one batched
    join), append the definitions to the pair's context and score again.

    ``closed_costs`` (repo_id, path, spent) is what closed pairs and earlier
    calls have cost.  Returns the same pairs; those with a ``stop_reason`` are closed.
    """
    limit, state = F.lit(None).cast("string"), open_
    if limits is not None:
        spent = state.select("repo_id", "path", "spent")
        state = _with_costs(state, spent if closed_costs is None else spent.unionByName(closed_costs))
        state = state.withColumn("file_costs", F.concat("file_costs", F.array("_file").cast(NO_COSTS)))
        state = state.withColumn("_limit", limits.reason(F.col("_repo"), F.col("_file"), F.col("file_costs"))).drop("_repo", "_file")
        limit = F.col("_limit")
    names = F.array_sort(F.transform("context_code", lambda c: c["name"]))
    chk = state.withColumn("_names", names).withColumn(
        "_reason",
        F.when(limit.isNotNull(), limit)
         .when(F.size("context_code") == 0, F.lit("no_context"))
         .when(F.col("prev_names").isNotNull() & (F.col("_names") == F.col("prev_names")), F.lit("same_names"))
         .when(F.col("prev_names").isNotNull() & (F.size("_names") == F.size("prev_names")), F.lit("same_count")))
    done = chk.filter(F.col("_reason").isNotNull()).withColumn("stop_reason", F.col("_reason")).select(*STATE_COLS)
    todo = chk.filter(F.col("_reason").isNull())
    if todo.isEmpty():
        return done
    req = (todo.select(*PAIR, F.posexplode("context_code").alias("k", "c"))
           .select(*PAIR, "k", F.col("c.name").alias("name"))
           .withColumn("request_id", F.struct(*PAIR, "k")))
    res, _ = resolve_symbols_batch(req.select("request_id", "repo_id", "name"), files, defs)
    found = (res.filter("found").select("request_id", "name", "file_path", "source")
             .join(req.select("request_id", *PAIR, "k"), "request_id")
             .groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct(
                 F.col("k").cast("int").alias("k"), F.col("name").alias("name"), F.col("name").alias("requested"),
                 F.col("file_path").alias("file_path"), F.col("source").alias("source")))).alias("_new")))
    nxt = (todo.join(found, PAIR, "left")
           .withColumn("ctx", F.concat("ctx", F.transform(F.coalesce("_new", F.array().cast(found.schema["_new"].dataType)),
                                                          lambda s: F.struct((F.size("ctx") + s["k"]).cast("int").alias("ord"),
                                                                             s["name"], s["requested"], s["file_path"], s["source"]))))
           .withColumn("previous", F.to_json(F.struct("scratchpad", "analysis", "poc", "confidence_score",
                                                       "vulnerability_types", "context_code")))
           .withColumn("prev_names", F.col("_names")))
    scored = _score(nxt.select(*PAIR, "previous", "ctx"), files, scorer, provider)
    cost = limits.cost() if limits is not None else F.lit(0)
    # a failed call keeps the last good reply and closes the pair; every reply meets its pair in one join, so
    # the scorer is called once a prompt
    replies = scored.select(*PAIR, F.struct(*REPLY).alias("_reply"), F.col("error").alias("_error"), cost.cast("bigint").alias("_cost"))
    met = nxt.join(replies, PAIR)
    bad = F.col("_error").isNotNull()
    again = met.select(*PAIR, *[F.when(bad, F.col(c)).otherwise(F.col(f"_reply.{c}")).alias(c) for c in REPLY], "ctx",
                       F.when(bad, F.col("round")).otherwise(F.lit(round_no)).alias("round"), "prev_names",
                       F.when(bad, F.lit("call_failed")).alias("stop_reason"),
                       (F.col("spent") + F.when(bad, F.lit(0)).otherwise(F.col("_cost"))).cast("bigint").alias("spent"), "file_costs")
    return done.unionByName(again)


def _kept(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(closed, open) pairs of one round, written once in two folders."""
    spark, path = rows.sparkSession, f"{checkpoint_dir(rows.sparkSession).rstrip('/')}/tables/{name}"
    schema = rows.schema
    rows.withColumn("_open", F.col("stop_reason").isNull()).write.mode("overwrite").partitionBy("_open").parquet(path)

    def part(value: str) -> DataFrame:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_open={value}")
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        return spark.read.schema(schema).parquet(f"{path}/_open={value}") if there else spark.createDataFrame([], schema)
    return part("false"), part("true")


def refine(files: DataFrame, initial: DataFrame, scorer, max_iterations: int = 7, provider: str = "openai",
           run_name: str | None = None, limits: Limits | None = None, prior: DataFrame | None = None,
           types: list[str] | None = None) -> DataFrame:
    """``initial``: repo_id, path, vuln_type, previous (initial reply JSON).

    ``limits`` are the cost rules; ``prior`` (repo_id, file_path or null,
    cost_nano) the calls made before, which count too; ``types`` keeps only
    the requested vulnerability types (none given: all).

    Returns one row per pair: last reply fields, last round scored, stop
    reason.  Each round's state is written to the shared checkpoint folder, in
    a folder of this run.
    """
    run_name = run_name or f"refine/{uuid.uuid4().hex}"
    if types:
        initial = initial.filter(F.col("vuln_type").isin(*types))
    # the initial scoring is often the dearest step: once for all that is made of it
    initial = cut_lineage(initial.select(*PAIR, "previous"), f"{run_name}/initial")
    if prior is not None:
        prior = cut_lineage(prior.groupBy("repo_id", F.col("file_path").alias("path")).agg(F.sum("cost_nano").cast("bigint").alias("spent")),
                            f"{run_name}/prior")
    defs = cut_lineage(definition_index(files), f"{run_name}/definitions")  # one index for all rounds
    closed, open_ = _kept(initial_state(files, initial, scorer, provider, limits, prior, run_name), f"{run_name}/round0")
    parts, costs = [closed], prior
    for i in range(1, max_iterations):
        if open_.isEmpty():
            break
        if limits is not None:
            # costs of closed pairs, by file: the one thing a round needs of them
            spent = closed.select("repo_id", "path", "spent")
            costs = cut_lineage((spent if costs is None else spent.unionByName(costs)).groupBy("repo_id", "path").agg(F.sum("spent").cast("bigint").alias("spent")),
                                f"{run_name}/costs{i}")
        closed, open_ = _kept(refine_round(open_, files, scorer, i, provider, defs, limits, costs), f"{run_name}/round{i}")
        parts.append(closed)
    parts.append(open_.withColumn("stop_reason", F.lit("max_iterations")))
    state = reduce(DataFrame.unionByName, parts)
    return state.select(*PAIR, "ok", "confidence_score", "analysis", F.col("round").alias("last_round"),
                        F.size("ctx").alias("n_context"), F.col("spent").alias("cost_nano"), "stop_reason", "scratchpad", "poc", "vulnerability_types")
