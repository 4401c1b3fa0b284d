"""Plan helpers: lineage cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from auditlens.session import checkpoint_dir


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Survives executor loss (the data lives in shared storage, not on an
    executor) and gives the optimizer fresh statistics.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
