"""Folders for checkpoints and for tables that queries write and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; where it is unset, one in the warehouse folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_runs"
    return root.rstrip("/")


def new_run(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh output and checkpoint folders under the shared folder."""
    base = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to a fresh shared folder and read again: a lost executor repeats no earlier work."""
    path, _ = new_run(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
