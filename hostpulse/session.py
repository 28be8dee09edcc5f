"""Session defaults for local runs; on a cluster the submitted configuration wins."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

LOCAL_SETTINGS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, *, name: str = "hostpulse", **settings: str) -> SparkSession:
    """A local session with as many shuffle partitions as cores."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**LOCAL_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach: the cluster's checkpoint folder.

    Only where none is configured and everything runs in one process (tests, a laptop) a temporary folder
    becomes the checkpoint folder; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    fallback = tempfile.mkdtemp(prefix="hostpulse-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback
