"""Physical-plan properties the design relies on (checked on the executed plan text)."""

import pytest

from conftest import SMOKE


def _plan(df):
    df.write.format("noop").mode("overwrite").save()  # run, so AQE shows its final plan
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def q():
    import __spark_entry__ as E
    return E.queries()


def test_flagship_is_map_only_until_the_final_aggregate(spark, q):
    p = _plan(q["findings_by_type_severity"](spark, SMOKE))
    assert "StringEndsWith(path,.py)" in p                      # path predicate reaches the parquet scan
    assert "content:string" in p and "doc_id" not in p.split("ReadSchema")[1][:200]  # column pruning
    assert p.count("Exchange hashpartitioning") == 1            # only the final aggregate shuffles
    for bad in ("SortMergeJoin", "NestedLoopJoin", "CartesianProduct", "EvalPython", "MapInPandas"):
        assert bad not in p


def test_pricing_needs_no_join(spark, q):
    p = _plan(q["call_costs"](spark, SMOKE))
    assert "Join" not in p and "EvalPython" not in p


def test_reference_search_shuffles_no_text(spark, q):
    p = _plan(q["resolve_reference"](spark, SMOKE))
    assert "BroadcastHashJoin" in p and "CartesianProduct" not in p
    assert not any("Exchange hash" in line and "content" in line for line in p.split("\n"))


def test_top_k_is_limited_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    from auditlens.operators.findings import top_findings
    f = spark.range(1000).select(F.col("id").alias("finding_ord"), (F.col("id") % 3).cast("string").alias("repo_id"),
                                 F.lit("HIGH").alias("severity"))
    p = top_findings(f, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p


def test_dims_are_local_relations(spark):
    from auditlens.functions import dims
    p = dims.rule_dim(spark)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in p and "PythonRDD" not in p
