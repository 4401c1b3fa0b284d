"""Slices of ordered groups, with bounds from the data.

Numbering or summing along an order needs the rows of a group in order, but a
group may hold a third of all rows.  A *slice* is a range of (group, order):
bounds are quantiles of a sample of the keys, fixed as literals, so the slice of a
row is an expression of its own keys.  It does not depend on partitioning, needs
no written table and comes out the same when an executor is lost.  Only keys are
counted; rows meet the offset of their slice by a join.

A slice holds about ``ROWS_PER_SLICE`` rows whatever the values of the key: sparse
numbers, timestamps and texts are cut where the rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SLICE = 200_000
MAX_SLICES = 4096
#: Sampled keys a slice; a slice is then within a few tenths of its size.
SAMPLE_PER_SLICE = 50

#: An order term: a column (ascending), or (column, False) for descending numbers.
Term = Column | tuple[Column, bool]


def sort_order(terms: list[Term]) -> list[Column]:
    """The terms as sort expressions (nulls first ascending, last descending)."""
    return [t[0].desc() if isinstance(t, tuple) and not t[1] else (t[0] if isinstance(t, tuple) else t).asc() for t in terms]


def _key(by: list[str], terms: list[Term]) -> Column:
    """(group, order) as one struct that compares like the sort order."""
    fields = [F.col(c) for c in by]
    for t in terms:
        c, up = t if isinstance(t, tuple) else (t, True)
        fields += [c] if up else [c.isNull().cast("int"), -c]
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(fields)])


def _literal(row, schema) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields, strict=True)])


def _slice(key: Column, bounds: list[Column]) -> Column:
    """Number of bounds at or below the key, by bisection."""
    table, steps = F.array(*bounds), len(bounds).bit_length()

    def halve(state, k):
        mid = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        below = F.get(table, mid) <= k
        return F.when(state["lo"] < state["hi"], F.struct(F.when(below, mid + 1).otherwise(state["lo"]).alias("lo"),
                                                          F.when(below, state["hi"]).otherwise(mid).alias("hi"))).otherwise(state)

    def search(k):
        start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: halve(s, k), lambda s: s["lo"])

    return F.element_at(F.transform(F.array(key), search), 1)


def with_slices(df: DataFrame, by: list[str], terms: list[Term], slices: int | None = None, out: str = "_slice") -> DataFrame:
    """Add ``out``: slices ascend with (by, terms), and rows of equal keys share one.

    One count of the rows; where they need more than one slice, one pass that
    brings about ``SAMPLE_PER_SLICE`` keys a slice to the driver.
    """
    keys = df.select(_key(by, terms).alias("k"))
    n = keys.count()
    want = slices or min(MAX_SLICES, -(-n // ROWS_PER_SLICE))
    if want < 2 or not n:
        return df.withColumn(out, F.lit(0))
    thin = max(1, n // (want * SAMPLE_PER_SLICE))
    # by hash, so the sample is the same on every evaluation; equal keys count once
    sample = keys.where(F.pmod(F.xxhash64("k"), F.lit(thin)) == 0).distinct().orderBy("k").select("k.*")
    rows = sample.collect()
    cuts = sorted({len(rows) * i // want for i in range(1, want)} - {0})
    if not cuts:
        return df.withColumn(out, F.lit(0))
    return df.withColumn(out, _slice(_key(by, terms), [_literal(rows[i], sample.schema) for i in cuts]))


def _offsets(cut: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by, _slice, _off): what the earlier slices of the group add up to; one row per group and slice."""
    totals = cut.groupBy(*by, "_slice").agg(value.alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))


def _meet(cut: DataFrame, by: list[str], offsets: DataFrame) -> DataFrame:
    """Rows with the offset of their slice (null groups meet too)."""
    right = offsets.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_slice").alias("_s"), "_off")
    same = F.col("_slice") == F.col("_s")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return cut.join(right, same).drop("_s", *[f"_by{i}" for i in range(len(by))])


def rank_two_level(df: DataFrame, by, order: list[Term], out: str = "pos", slices: int | None = None) -> DataFrame:
    """1-based row number per ``by`` group in ``order``; no task sorts more than one slice of a group.

    Equal to ``row_number() over (partition by by order by order)`` when
    ``order`` is a total order within each group.
    """
    by = list(by)
    cut = with_slices(df, by, order, slices)
    local = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(*sort_order(order)))
    return (_meet(cut.withColumn("_local", local), by, _offsets(cut, by, F.count(F.lit(1))))
            .withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint")).drop("_slice", "_local", "_off"))


def prefix_sum(df: DataFrame, part, order: str, value: str, out: str, inclusive: bool = True, slices: int | None = None) -> DataFrame:
    """Running sum of ``value`` per ``part`` in ``order`` (any sortable key: numbers however sparse, timestamps, texts)."""
    part = list(part)
    cut = with_slices(df, part, [F.col(order)], slices)
    window = Window.partitionBy(*part, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = F.coalesce(F.sum(value).over(window), F.lit(0))
    return (_meet(cut.withColumn("_inner", inner), part, _offsets(cut, part, F.sum(value)))
            .withColumn(out, (F.col("_off") + F.col("_inner")).cast("bigint")).drop("_slice", "_off", "_inner"))
