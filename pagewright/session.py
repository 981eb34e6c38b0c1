"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "pagewright") -> SparkSession:
    """Build (or reuse) a session with AQE, UTC and Arrow switched on.

    On a cluster, leave ``master`` and ``shuffle_partitions`` unset: the
    cluster's own settings win and AQE coalesces shuffle partitions at run
    time.  Tests pass ``local[*]`` and a small partition count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # Local mode runs everything in the driver JVM.
            builder = builder.config("spark.driver.memory",
                                     os.environ.get("PAGEWRIGHT_DRIVER_MEMORY", "16g"))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Checkpoint files go once nothing refers to them (long-running feed).
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only in local mode.

    The cluster names its shared folder in ``spark.checkpoint.dir``; that
    setting is always read first.  Only a local session (tests, bench) with
    no such setting gets a fresh folder of its own.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a folder every executor can reach"
        )
    path = tempfile.mkdtemp(prefix="pagewright-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediate tables, beside the checkpoints."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if not base:
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a folder every executor can reach")
    return f"{base}/pagewright-{name}-{uuid.uuid4().hex}"


def materialize(df, name: str = "tmp", compression: str | None = None):
    """Write ``df`` once as Parquet in the shared checkpoint folder and read
    it back: cuts the lineage (a lost executor re-reads instead of
    recomputing) and lets a result used twice be computed once.
    ``compression`` names a codec other than the session's (long texts)."""
    path = work_dir(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)
