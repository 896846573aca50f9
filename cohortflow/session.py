"""Session helpers: the caller owns the SparkSession; these only read and tune it."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every job in the package is written for. AQE re-plans joins and
# coalesces shuffle output at runtime; skew-join splits a hot subject key.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  checkpoint_dir: str | None = None, extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, build the session yourself and pass it in."""
    b = (SparkSession.builder.master(master).appName("cohortflow")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if checkpoint_dir:
        ensure_checkpoint_dir(spark, checkpoint_dir)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, default: str | None = None) -> str | None:
    """Use the cluster's ``spark.checkpoint.dir``; set ``default`` only when none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    target = conf or default
    if target:
        sc.setCheckpointDir(target)
        return sc.getCheckpointDir()
    return None


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that driver and executors share: the checkpoint folder, else the warehouse."""
    root = ensure_checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage of a small intermediate that several jobs reuse.

    Reliable ``checkpoint()`` into the shared checkpoint directory when one is configured
    (survives executor loss without recomputing the upstream scan); otherwise a
    MEMORY_AND_DISK persist, whose lost blocks Spark recomputes from lineage.
    """
    if ensure_checkpoint_dir(df.sparkSession):
        # persist first: the checkpoint write then reads the cached blocks instead of
        # recomputing the upstream plan a second time
        cached = df.persist(StorageLevel.MEMORY_AND_DISK)
        out = cached.checkpoint(eager=True)
        cached.unpersist()
        return out
    return df.persist(StorageLevel.MEMORY_AND_DISK)
