"""Cutting the plan where a small table is read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder the session names (spark.checkpoint.dir). Only a local session may
    lack that setting and gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tradelift-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4()}"


def cut(df: DataFrame) -> DataFrame:
    """The rows written once as a parquet table in the shared folder and read back, so a lost executor
    re-reads the table instead of the fact. A checkpoint would run the last stage twice."""
    path = work_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
