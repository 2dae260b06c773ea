"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every docweave job relies on.  AQE re-plans joins from runtime sizes
# and splits skewed shuffle partitions; ANSI stays on (the Spark 4 default), so
# operators use try_divide / try_element_at where a zero or a miss is expected.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Let AQE turn a sort-merge join into a shuffled hash join when every
    # build-side partition is small (skips two sorts).
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Small local inputs: keep one post-shuffle task per core for the
    # CPU-heavy text stages instead of merging partitions below 1 MB.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256KB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "docweave", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster, pass the cluster's own settings in ``extra``."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process (and share its folders)."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    Uses ``spark.checkpoint.dir`` as configured for the cluster, and raises if a
    cluster has none.  Only in a local session (tests) a fresh scratch folder
    is created and registered where it is unset.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="docweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local
