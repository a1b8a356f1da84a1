"""Tables on storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set a local one, if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: later plans don't compute it anew, and a lost executor costs its tasks only."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
