"""Spark session helpers.

The engine never assumes a machine-local scratch folder: lineage is cut by
writing to the shared folder named by ``spark.checkpoint.dir``.  Only when a
session has no such setting (local tests) do we pick one under /tmp.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what the planner can prove small; dims are hinted explicitly.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "auditlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("AUDITLENS_DRIVER_MEM", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and state tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir).  When unset, a local session (tests) gets one under /tmp;
    on a cluster a machine-local folder would lose rows, so this raises.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="auditlens-ckpt-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``auditlens`` importable in Python workers (once per application).

    Operators that run Python on executors (scoring hook, source-tree
    supplement, stateful alerts) call this; it zips the package into the
    shared checkpoint folder and registers it with ``addPyFile`` - the
    programmatic form of ``--py-files``.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    ck = checkpoint_dir(spark)
    # addPyFile uploads a driver-side file to every executor; the checkpoint
    # folder is used when it is a local/mounted path, else a driver temp file
    folder = ck.replace("file:", "") if (ck.startswith("file:") or "://" not in ck) else tempfile.mkdtemp(prefix="auditlens-pkg-")
    target = os.path.join(folder, f"auditlens-{app}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(pkg):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(app)
