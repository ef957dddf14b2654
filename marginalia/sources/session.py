"""The session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder for tables or checkpoints below spark.checkpoint.dir; one of our own where that is unset and Spark is local."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(found)
    return f"{found}/{kind}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = shared_folder(spark, "tables")
    df.write.parquet(path)
    return spark.read.parquet(path)
