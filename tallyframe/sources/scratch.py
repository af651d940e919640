"""Folders for intermediate files: in the shared folder that the session names, in a local one only where the session is local."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one set for checkpoints; a temporary one if the session runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='tallyframe-')}"
    spark.sparkContext.setCheckpointDir(base)
    return base


def folder(spark: SparkSession, label: str) -> str:
    """A new path in it."""
    return f"{shared(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read again, so that what is used twice is computed once."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
