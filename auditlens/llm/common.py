"""Shared helpers of the training-data operators: input, scratch tables, numbering, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlens.session import checkpoint_dir, ship_package

WORD_CLASS = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; ``sf_dir`` may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage on storage that outlives executors, and lets several readers
    use one evaluation.  ``drop`` removes it when nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files behind a frame made by ``written``."""
    path = getattr(df, "_scratch", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ready(spark: SparkSession) -> None:
    """Make the package importable in Python workers."""
    ship_package(spark)


def slices_for(n_rows: int, rows_per_slice: int = 100_000) -> int:
    """Number of slices so that each holds about ``rows_per_slice`` rows."""
    return max(1, -(-n_rows // rows_per_slice))


def number_rows(df: DataFrame, by: list[str], order: Column, slices: int, out: str) -> DataFrame:
    """Gapless numbers from 0 within each ``by`` group, in a fixed pseudo-random order.

    Rows are dealt into ``slices`` by a hash of ``order`` and numbered inside
    their slice; the slice offsets come from per-slice counts.  No window ever
    holds a whole group, only one slice of it, so a group with a third of all
    rows is numbered by many tasks.  ``order`` must be unique within a group.
    """
    cut = df.withColumn("__slice", F.pmod(F.xxhash64(order), F.lit(slices)).cast("int")).withColumn("__order", order)
    counts = cut.groupBy(*by, "__slice").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__slice").orderBy("__order")
    numbered = cut.withColumn("__row", F.row_number().over(inside))
    return (numbered.join(offsets, [*by, "__slice"])  # offsets: one row per slice and group
            .withColumn(out, (F.col("__before") + F.col("__row") - 1).cast("bigint"))
            .drop("__slice", "__order", "__before", "__row", "__n"))


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node of its component.

    Alternates large-star and small-star steps over written tables (Kiveris et
    al., 2014): each step links a node's neighbours to the least one, so the
    edges shrink to one star per component in a logarithmic number of rounds.
    Only counts reach the driver.
    """
    def both_ways(e):
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e, name):
        # the least neighbour (or self) per node, then every neighbour points to it
        least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return least, e.join(least, "a")

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    for _ in range(max_rounds):
        # large star: neighbours greater than the node point to the node's least neighbour
        _, j = star(both_ways(now), name)
        large = written(j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), name)
        # small star: smaller neighbours and the node itself point to the least of them
        least, j = star(large, name)
        small = (j.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        nxt = written(small, name)
        drop(large)
        same = nxt.select("a", "b").exceptAll(now.select("a", "b")).isEmpty() and nxt.count() == now.count()
        drop(now)
        now = nxt
        if same:
            break
    else:
        raise RuntimeError(f"components of {name} did not converge in {max_rounds} rounds")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
