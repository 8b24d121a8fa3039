"""Session settings the jobs are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings that matter for results (UTC, ANSI) or for skewed joins (AQE).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "docfields", master: str | None = None, **extra: str) -> SparkSession:
    """Build (or get) a session; ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from ``spark.checkpoint.dir``.

    Only a session on one machine may do without the setting; it gets a scratch folder. Elsewhere each executor would
    write to its own disk, so that raises.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(checkpoint_dir, "scratch"):
        checkpoint_dir.scratch = tempfile.mkdtemp(prefix="docfields-checkpoint-")
        spark.sparkContext.setCheckpointDir(checkpoint_dir.scratch)
    return checkpoint_dir.scratch
