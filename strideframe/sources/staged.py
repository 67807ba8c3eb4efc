"""Folders for tables that are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: For local sessions that name no shared folder.
LOCAL_ROOT = "/tmp/checkpoints"


def staged_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which driver and executors share; only a local session may leave that unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or LOCAL_ROOT).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: every later reader sees the same rows."""
    path = staged_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
