"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "tidepanel", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Window and matrix steps cost far more CPU than their bytes suggest, so the adaptive planner
# must not merge their small partitions into a single task.
MIN_PARTITION_KEY = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
MIN_PARTITION = "16k"


def pin_session(spark: SparkSession) -> SparkSession:
    """Every date rule assumes a UTC session clock; small CPU-heavy partitions stay apart."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get(MIN_PARTITION_KEY, None) != MIN_PARTITION:
        spark.conf.set(MIN_PARTITION_KEY, MIN_PARTITION)
    return spark


def _checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local session without one gets its own."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is not None:
        return current
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint a table that several branches of a plan read, so its inputs are scanned once.

    The files live in the shared folder, so a lost executor re-reads them instead of redoing
    the scan.
    """
    _checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder for a table a job writes and reads back."""
    return f"{_checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
