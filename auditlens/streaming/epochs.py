"""Keyed tables that a stream writes epoch by epoch.

Each micro-batch writes the rows of the keys that it changed to a folder of its own,
``delta-<epoch>``; a batch that runs again replaces that folder and nothing else.
A reader takes the newest row of each key.  Now and then the epochs before the
running one, which are committed, are merged into one ``merged-<epoch>`` folder.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MERGE_EVERY = 50


def _folders(spark: SparkSession, folder: str):
    """(file system, {epoch: delta path}, {epoch: merged path}) of complete folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, dict[int, str]] = {"delta": {}, "merged": {}}
    if fs.exists(path):
        for status in fs.listStatus(path):
            m = re.fullmatch(r"(delta|merged)-(\d+)", status.getPath().getName())
            if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found[m.group(1)][int(m.group(2))] = status.getPath().toString()
    return fs, found["delta"], found["merged"]


def write_epoch(rows: DataFrame, folder: str, epoch: int) -> None:
    """Write or replace the rows of one epoch."""
    rows.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/delta-{epoch}")


def read_newest(spark: SparkSession, folder: str, keys, before: int | None = None) -> DataFrame | None:
    """The newest row of each key, of the epochs before ``before``; None while there is none.

    Partial aggregation in each task leaves one row a key before the shuffle.
    """
    _, deltas, merged = _folders(spark, folder)
    inside = lambda e: before is None or e < before
    base = max(filter(inside, merged), default=-1)
    paths = [p for e, p in deltas.items() if e > base and inside(e)] + ([merged[base]] if base >= 0 else [])
    if not paths:
        return None
    rows = spark.read.parquet(*sorted(paths))
    values = [c for c in rows.columns if c not in (*keys, "epoch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values, "epoch"), "epoch").alias("_r"))
    return newest.select(*keys, "_r.*")


def merge_epochs(spark: SparkSession, folder: str, keys, before: int) -> None:
    """Replace all folders of the epochs before ``before`` by one.

    The merged folder counts once it is complete; a failure before the old ones
    are gone leaves rows that say the same.
    """
    fs, deltas, merged = _folders(spark, folder)
    done = [e for e in deltas if e < before]
    if not done:
        return
    last = max(done)
    read_newest(spark, folder, keys, before).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/merged-{last}")
    for path in [deltas[e] for e in done] + [p for e, p in merged.items() if e < last]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def epoch_writer(folder: str, keys, merge_every: int = MERGE_EVERY):
    """For ``foreachBatch``: keep the changed rows of each epoch."""
    def batch(df: DataFrame, epoch: int) -> None:
        write_epoch(df, folder, epoch)
        if epoch and epoch % merge_every == 0:
            merge_epochs(df.sparkSession, folder, keys, epoch)
    return batch
