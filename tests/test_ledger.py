from pyspark.sql import functions as F

from auditlens.operators.ledger import (budget_gate, call_costs, escalation_stop, estimate_file_costs,
                                        resolve_pricing)


def test_pricing_tiers(spark):
    keys = ["gpt-4o", "GPT-4o-mini", "claude-9-x", "gpt-4-0613", "gpt-3.5-x", "mystery", "", "claude-3-haiku-20240307", "llama3.2"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    p = {r.key: (r.in_nano, r.out_nano, r.match) for r in resolve_pricing(df).collect()}
    assert p["gpt-4o"] == (5000, 15000, "exact")
    assert p["GPT-4o-mini"] == (5000, 15000, "partial")       # contains 'gpt-4o' (case-insensitive)
    assert p["claude-9-x"] == (3000, 15000, "provider")
    assert p["gpt-4-0613"] == (10000, 30000, "provider")
    assert p["gpt-3.5-x"] == (500, 1500, "provider")
    assert p["mystery"] == (10000, 30000, "default")
    assert p[""][2] == "partial" and p[""][0] == 3000          # empty name matches the first entry
    assert p["claude-3-haiku-20240307"] == (250, 1250, "exact")
    assert p["llama3.2"] == (0, 0, "partial")


def test_estimate_planning_model(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, "abcde")], "id long, content string")
    e = {r.id: r for r in estimate_file_costs(df, "gpt-4o").collect()}
    # t = 1 → round(1 + 3000 + 5501 * 12.5) = 71764; t = 2 → 71777
    assert e[1].estimated_input_tokens == 71764 and e[2].estimated_input_tokens == 71777
    assert e[1].estimated_output_tokens == 33250 and e[1].estimated_calls == 14


def _calls(spark, rows):
    return call_costs(spark.createDataFrame(rows, "scan_id long, seq long, file_path string, call_type string, model string, "
                                                  "input_tokens long, output_tokens long"))


def test_budget_gate_monotone(spark):
    rows = [(1, i, f"f{i % 5}", "initial", "gpt-4o", 1000, 0) for i in range(1, 21)]
    g = budget_gate(_calls(spark, rows), 0.05).orderBy("first_seq").collect()
    adm = [r.admitted for r in g]
    assert adm == sorted(adm, reverse=True)          # once closed it stays closed
    assert [r.spent_before_nano for r in g][0] == 0


def test_escalation(spark):
    toks = [100, 100, 200, 400, 800]
    rows = [(1, i + 1, "f", "secondary-LFI", "gpt-4o", t, 0) for i, t in enumerate(toks)]
    d = escalation_stop(_calls(spark, rows), mode="delta").collect()
    assert d[0].stop_seq == 4  # 100 < 0.8*200 and 200 < 0.8*400 first holds at the 4th call


def test_budget_gate_counts_calls_without_a_file(spark):
    from auditlens.operators.ledger import budget_gate
    costs = spark.createDataFrame([(1, None, 1, 100), (1, "a.py", 2, 10), (1, "b.py", 3, 10)], "scan_id long, file_path string, seq long, cost_nano long")
    got = {r.file_path: (r.spent_before_nano, r.admitted) for r in budget_gate(costs, 105e-9).collect()}
    assert got == {"a.py": (100, True), "b.py": (110, False)}


def test_budgets_in_timestamp_order(spark, monkeypatch):
    """One hot scan, calls in bursts: the same results as by dense numbers, and no window far above a slice."""
    from auditlens.functions import slices
    from auditlens.operators.ledger import budget_gate, budget_warning, remaining_budget
    monkeypatch.setattr(slices, "ROWS_PER_SLICE", 500)
    n = F.col("id")
    calls = spark.range(6000).select(F.when(n % 4 > 0, F.lit(1)).otherwise(F.lit(2) + n % 5).cast("bigint").alias("scan_id"), (n + 1).alias("seq"),
                                     F.timestamp_micros(1_700_000_000_000_000 + F.when(n % 1000 < 990, n).otherwise(n * 3_600_000_000)).alias("ts"),
                                     F.when(n % 11 > 0, F.concat(F.lit("f"), F.floor(n / 7))).alias("file_path"), (n % 13).alias("cost_nano"))
    # numbers in the order of the timestamps
    from pyspark.sql import Window
    dense = calls.withColumn("seq", F.row_number().over(Window.partitionBy("scan_id").orderBy("ts")).cast("bigint"))
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    assert key(budget_gate(calls, 1e-5, order="ts"), "scan_id", "file_path", "spent_before_nano", "admitted") == \
        key(budget_gate(dense, 1e-5), "scan_id", "file_path", "spent_before_nano", "admitted")
    assert key(budget_warning(calls, 1e-5, order="ts"), "scan_id", "running_nano", "pct") == key(budget_warning(dense, 1e-5), "scan_id", "running_nano", "pct")
    assert key(remaining_budget(calls, 1e-5, order="ts"), "scan_id", "ts", "remaining_nano") == key(remaining_budget(dense, 1e-5), "scan_id", "ts", "remaining_nano")
    cut = slices.with_slices(calls, ["scan_id"], [F.col("ts")])
    assert max(r["count"] for r in cut.groupBy("scan_id", "_slice").count().collect()) < 1500
