"""Spark session settings used by tests, bench and the driver entry point."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "ranklab") -> SparkSession:
    """A session tuned for this library.

    AQE stays on: it coalesces small shuffle partitions, turns joins whose
    runtime side is under ``autoBroadcastJoinThreshold`` into broadcast joins
    (the size check behind every broadcast of derived data) and splits skewed
    sort-merge-join partitions. The session time zone is UTC because all
    schedule and deadline arithmetic is in UTC.
    """
    master = master or os.environ.get("RANKLAB_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("RANKLAB_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, creating a local one only when
    the cluster did not name one (``spark.checkpoint.dir``).

    On a cluster the setting points at shared storage and is left alone; a
    machine-local temporary folder is only used when nothing is configured,
    which is the local/test situation.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="ranklab-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
