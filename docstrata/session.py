"""Spark session and lineage helpers.

Every job in the package is a DataFrame plan; this module only builds a
session for tests / the bench and finds the shared folder named by
``spark.checkpoint.dir``, where stages are written (never a machine-local
folder on a cluster).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "docstrata") -> SparkSession:
    """Session for local runs (tests, bench). On a cluster the caller's
    session is used as is; nothing here is required by the operators."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.ansi.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only on a local master
    (tests) a fresh scratch folder is taken when it is unset; elsewhere that
    folder would be each machine's own, so it is an error.
    """
    conf_dir = spark.conf.get(CHECKPOINT_CONF, None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext (Connect): the conf is all there is
        if conf_dir:
            return conf_dir
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share") from None
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="docstrata-ckpt-")
    spark.conf.set(CHECKPOINT_CONF, local)
    sc.setCheckpointDir(local)
    return local


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the workers of the session (once per application), so that Python
    functions run where the package is not installed and not on their path."""
    import shutil

    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext (Connect): the cluster has to have the package
        return
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    aside = tempfile.mkdtemp(prefix="docstrata-ship-")  # the driver's; Spark hands the archive out
    sc.addPyFile(shutil.make_archive(f"{aside}/docstrata", "zip", os.path.dirname(package), os.path.basename(package)))
    _shipped.add(sc.applicationId)
