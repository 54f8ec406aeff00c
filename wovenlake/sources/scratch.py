"""Intermediate tables of iterative jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's checkpoint folder; a local one only where neither is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        current = context._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="wovenlake-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: the plan of a loop stays short, and lost executors cost one step."""
    path = f"{shared_folder(df.sparkSession)}/wovenlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
