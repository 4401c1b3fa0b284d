"""The skew-safe constructions must equal their single-window forms."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditlens.functions.slices import prefix_sum, rank_two_level, sort_order, with_slices


def _skewed(spark):
    # one hot key holds most rows; ties broken by id so the order is total
    rows = [("hot", i % 7, i) for i in range(3000)] + [(f"k{i % 5}", i % 3, i) for i in range(200)]
    return spark.createDataFrame(rows, "k string, score int, id long")


def test_rank_two_level_equals_row_number(spark):
    df = _skewed(spark)
    order = [(F.col("score"), False), F.col("id")]
    got = {(r.k, r.id): r.pos for r in rank_two_level(df, ["k"], order, slices=16).collect()}
    ref = {(r.k, r.id): r.pos for r in df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy(*sort_order(order)))).collect()}
    assert got == ref


def test_prefix_sum_equals_running_window(spark):
    df = _skewed(spark).withColumn("v", (F.col("id") % 13).cast("long"))
    w = Window.partitionBy("k").orderBy("id")
    ref_inc = {r.id: r.s for r in df.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).collect()}
    ref_exc = {r.id: (r.s or 0) for r in df.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1))).collect()}
    inc = {r.id: r.s for r in prefix_sum(df, ["k"], "id", "v", "s", inclusive=True, slices=16).collect()}
    exc = {r.id: r.s for r in prefix_sum(df, ["k"], "id", "v", "s", inclusive=False, slices=16).collect()}
    assert inc == ref_inc and exc == ref_exc


def test_top_findings_bounded_and_overflow(spark):
    from auditlens.operators.findings import top_findings
    rows = [(i, "hot" if i < 500 else "cold", ["INFO", "LOW", "HIGH", "CRITICAL"][i % 4]) for i in range(520)]
    f = spark.createDataFrame(rows, "finding_ord long, repo_id string, severity string")
    t = top_findings(f, 5).collect()
    hot = sorted((r.pos, r.finding_ord, r.severity, r.n_more) for r in t if r.repo_id == "hot")
    assert [x[1] for x in hot] == [3, 7, 11, 15, 19] and {x[2] for x in hot} == {"CRITICAL"} and hot[0][3] == 495


def test_slices_of_sparse_keys(spark):
    """Timestamps in bursts, a hot scan, equal values in many scans: no slice far above its share, sums as in one window."""
    gaps = F.when(F.col("id") % 50 == 0, F.col("id") * 7_000_000).otherwise(F.col("id"))
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("scan"),
                                    F.timestamp_micros(1_700_000_000_000_000 + gaps).alias("ts"), "id", (F.col("id") % 9).alias("v"))
    cut = with_slices(df, ["scan"], [F.col("ts")], slices=20)
    sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2.5 * 20_000 / 20
    plain = Window.partitionBy("scan").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r.s for r in df.withColumn("s", F.sum("v").over(plain)).collect()}
    got = prefix_sum(df, ["scan"], "ts", "v", "s", slices=20)
    assert {r.id: r.s for r in got.collect()} == want
    windows = [r["n"] for r in cut.groupBy("scan", "_slice").agg(F.count("*").alias("n")).collect()]
    assert max(windows) < 2.5 * 20_000 / 20


def test_rank_of_odd_keys(spark):
    """Null groups and values, descending nulls, ties within a slice, few rows and none."""
    rows = [(None if i % 5 == 0 else f"g{i % 3}", None if i % 7 == 0 else float(i % 11), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, score double, id long")
    order = [(F.col("score"), False), F.col("id")]
    want = {r.id: r.pos for r in df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy(*sort_order(order)))).collect()}
    for slices in (None, 1, 7, 600):
        assert {r.id: r.pos for r in rank_two_level(df, ["g"], order, slices=slices).collect()} == want
    assert rank_two_level(df.where("id < 0"), ["g"], order, slices=4).collect() == []
    assert rank_two_level(df.where("id = 3"), ["g"], order, slices=4).first()["pos"] == 1


def test_numbering_writes_nothing(spark):
    import os

    from auditlens.operators.findings import number_findings
    from auditlens.session import checkpoint_dir
    folder = checkpoint_dir(spark).replace("file:", "")
    before = sum(len(f) for _, _, f in os.walk(folder))
    f = spark.range(2000).select(F.col("id").alias("finding_ord"), (F.col("id") % 3).cast("string").alias("repo_id"), F.lit("HIGH").alias("severity"),
                                 F.lit(5.0).alias("confidence"), F.lit("wide text").alias("analysis"))
    out = number_findings(f)
    assert sum(len(f) for _, _, f in os.walk(folder)) == before
    assert out.count() == 2000


def test_history_halo_equals_one_window(spark, monkeypatch):
    from auditlens.operators import prompts as P
    rows = [("hot", i, "system" if i % 17 == 0 else ("user" if i % 2 else "assistant"), f"text {i} " + "x" * (i % 5)) for i in range(300)]
    rows += [(f"c{i}", t, "user", f"m{t}") for i in range(20) for t in range(i % 4)]
    m = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    want = {}
    for conv in {r[0] for r in rows}:
        said = sorted((r for r in rows if r[0] == conv and r[2] != "system"), key=lambda r: r[1])
        for i, r in enumerate(said):
            if r[2] == "user":
                want[conv, r[1]] = "\n".join(f"<{x[2]}>{x[3][:8]}</{x[2]}>" for x in said[max(0, i - 5):i]) if i >= 2 else None
    for block in (5, 8, 100, 8192):
        monkeypatch.setattr(P, "HISTORY_BLOCK", block)
        got = P.history_window(m, chars=8)
        assert {(r.conv_id, r.turn): r.context for r in got.collect()} == want
