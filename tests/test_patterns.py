"""Rule tables: same hits as inline rules, any number of rules, all families."""

import re

from pyspark.sql import functions as F

from auditlens.functions import dims
from auditlens.operators import patterns as P

RULES = [("a", r"open\s*\("), ("a", r"(?i)WebSocket"), ("b", r"x|y"), ("b", r"[0-9]{4}"), ("c", r"é+t"), ("c", r"ab"), ("d", r"open\s*\("), ("a", r"open\s*\("),
         ("e", r"never\.seen"), ("f", r"(?i)straße"), ("g", r"^start"), ("h", r"foo.bar"), ("h", r"longliteral(one|two)")]
TEXTS = ["open (f)", "OPEN(f)", "a websocket", "WEBSOCKET y", "été", "ab 2024", "", "start open(", "xlongliteraltwo foo\nbar", "longliteralthree foo-bar", "STRASSE straße", None]


def _hits(spark, rules, texts=None):
    df = spark.createDataFrame(list(enumerate(texts or TEXTS)), "id long, text string")
    return sorted(map(tuple, P.pattern_family_hits(df, ["id"], "text", rules).collect()))


def test_rule_table_equals_inline_rules(spark, monkeypatch):
    table = spark.createDataFrame(RULES, "family string, pattern string")
    inline = _hits(spark, RULES)
    assert inline and _hits(spark, table) == inline
    monkeypatch.setattr(P, "RULE_BLOCK_BYTES", 300)  # several passes
    assert _hits(spark, table) == inline
    assert _hits(spark, spark.createDataFrame(dims.NETWORK_PATTERNS, "family string, pattern string")) == _hits(spark, None)


def test_filter_by_rule_table_keeps_equal_rows_and_drops_nulls(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])], "id long, text string")
    got = P.filter_network_files(df, spark.createDataFrame(RULES, "family string, pattern string"), "text")
    want = P.filter_network_files(df, RULES, "text")
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_fifty_thousand_rules(spark):
    """No cap, and a text meets few of the rules."""
    rules = spark.range(50_000).select(F.concat(F.lit("fam"), F.col("id") % 100).alias("family"), F.concat(F.lit("call_"), F.col("id"), F.lit(r"\s*\(")).alias("pattern"))
    texts = [f"x = call_{i} (y) + call_{i + 1}" for i in range(0, 50_000, 500)]
    got = _hits(spark, rules, texts)
    want = sorted((n, f"fam{r % 100}", 1) for n, t in enumerate(texts) for r in [int(re.match(r"x = call_(\d+)", t).group(1))])
    assert got == want
    plan = P.rule_matches(spark.createDataFrame([(1, "call_1(")], "id long, text string"), ["id"], "text", rules)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hash" not in plan and "Limit" not in plan


def test_every_family_is_hit(spark):
    import __spark_entry__ as E
    from conftest import SMOKE
    rows = E.queries()["rule_table_hits"](spark, SMOKE).collect()
    assert {r.family for r in rows} == {f for f, _ in dims.NETWORK_PATTERNS}
