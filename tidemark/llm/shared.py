"""Tables and folders that the driver and all executors can see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..tables import run_folder


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{run_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, so a lost
    executor costs a reread, and its exact size is known to the planner."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
