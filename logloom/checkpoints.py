"""Reliable checkpoints in the folder the cluster names."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        # A local session has one machine only; a cluster must name a folder all executors share.
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="logloom-checkpoint-")
    context.setCheckpointDir(configured)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder; lost executors do not lose it, and partitions stay as they are."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path beside the checkpoints, for tables that a query writes and reads back."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once beside the checkpoints, for results that several branches of a plan read.

    Unlike a checkpoint it computes ``df`` only once, but partitions and row order are not kept.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this session has written beside its checkpoints. Call it when no result is read any more.

    The folder is the session's own, below the one that ``spark.checkpoint.dir`` names.
    """
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for entry in store.listStatus(path):
            store.delete(entry.getPath(), True)
