from auditlens.plans.catalog import QUERIES
from conftest import SMOKE


def test_stream_alerts_equal_batch(spark):
    import duckdb

    from auditlens.sources.tables import TABLES
    from oracle_check import rows_of
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    for name in ("stream_budget_alerts", "stream_cost_totals"):
        fn, sql = QUERIES[name]
        df = fn(spark, SMOKE)
        cur = con.execute(sql)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def _rows(spark, path):
    import os
    if not os.path.isdir(path):
        return []
    return sorted(map(tuple, spark.read.parquet(path).collect()))


def test_alert_epochs_can_run_again(spark, tmp_path, monkeypatch):
    """One scan of 200 000 calls in one batch; an epoch that runs again changes neither alerts nor state."""
    from pyspark.sql import functions as F

    from auditlens.functions import slices
    from auditlens.streaming.epochs import read_newest
    from auditlens.streaming.streams import alert_batch
    monkeypatch.setattr(slices, "ROWS_PER_SLICE", 20_000)
    calls = spark.range(200_000).select(F.lit(7).cast("long").alias("scan_id"), (F.col("id") * 1000 + 5).alias("seq"), F.lit("openai/gpt-4o").alias("model"),
                                        F.lit(1000).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))
    few = calls.limit(10).withColumn("scan_id", F.lit(None).cast("long"))  # a call without a scan
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    from auditlens.streaming.streams import with_cost
    per_call = with_cost(calls).first()["cost_nano"]
    budget = 150_000 * per_call / 1e9
    first, second = calls.where("seq < 100000000"), calls.where("seq >= 100000000")
    for _ in range(2):
        alert_batch(first.unionByName(few), 0, out, state, budget)
    assert _rows(spark, f"{out}/epoch=0") == []
    for _ in range(2):
        alert_batch(second, 1, out, state, budget)
    want = [(7, "exceeded", 149_999 * 1000 + 5, 150_000 * per_call), (7, "warning", 119_999 * 1000 + 5, 120_000 * per_call)]
    assert _rows(spark, f"{out}/epoch=1") == want
    alert_batch(second.limit(5), 2, out, state, budget, merge_every=2)
    assert _rows(spark, f"{out}/epoch=2") == []  # once only
    now = {r.scan_id: r for r in read_newest(spark, state, ["scan_id"]).collect()}
    assert now[7].total_nano == 200_005 * per_call and now[7].warning and now[7].exceeded
    assert now[None].total_nano == 10 * per_call and not now[None].warning and now[None].epoch == 0


def test_totals_write_changed_keys_only(spark, tmp_path):
    from pyspark.sql import functions as F

    from auditlens.streaming.epochs import epoch_writer, merge_epochs, read_newest
    folder = f"{tmp_path}/totals"
    table = lambda lo, hi, v: spark.range(lo, hi).select(F.col("id").alias("scan_id"), F.lit(v).alias("calls"))
    keep = epoch_writer(folder, ["scan_id"])
    keep(table(0, 1000, 1), 0)
    keep(table(10, 13, 2), 1)
    keep(table(10, 13, 2), 1)  # again
    keep(table(12, 14, 3), 2)
    assert spark.read.parquet(f"{folder}/delta-1").count() == 3
    newest = lambda **k: {r.scan_id: r.calls for r in read_newest(spark, folder, ["scan_id"], **k).collect()}
    want = {i: 3 if i in (12, 13) else 2 if i in (10, 11) else 1 for i in range(1000)}
    assert newest() == want
    assert newest(before=2)[12] == 2 and newest(before=1)[12] == 1
    merge_epochs(spark, folder, ["scan_id"], 2)
    import os
    assert sorted(os.listdir(folder)) == ["delta-2", "merged-1"] and newest() == want
    keep(table(5, 6, 9), 3)
    merge_epochs(spark, folder, ["scan_id"], 4)
    assert sorted(os.listdir(folder)) == ["merged-3"] and newest() == {**want, 5: 9}
    assert read_newest(spark, f"{tmp_path}/none", ["scan_id"]) is None
