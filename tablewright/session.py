"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablewright")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def _shared_root(spark: SparkSession, prefix: str) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a local session without it gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def durable(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read back.

    Every reader of the result sees the same rows, also after executors are lost, and reads only the columns
    it needs (a plain ``checkpoint`` keeps whole rows and is slower to write).
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder for written tables, next to the checkpoints."""
    return f"{_shared_root(spark, 'tablewright-out-').rstrip('/')}/tablewright-{uuid.uuid4().hex}"
