"""Structured Streaming: exchanges landed as files, and node aggregates kept up to date.

All node aggregates are distributive, so the state is one row for each (endpoint, status, path, family); order
comes from ``ord``, and late files change first and last sights only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import shapes
from ..sources.exchanges import with_endpoint

LANDED = "ord long, method string, path string, status int, content_type string, body string"


def landed(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of landed exchanges (Parquet files of the ``LANDED`` columns)."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def node_counts(stream: DataFrame) -> DataFrame:
    """The aggregates of ``shapes.nodes``, kept up to date."""
    parts = shapes.walked(with_endpoint(stream).select("endpoint", "status", "ord", "body"))
    seen = F.min(F.struct("first_ord", "first_pos"))
    found = parts.groupBy("endpoint", "status", "path", "family").agg(F.sum("n").alias("samples"), F.bool_and("all_int").alias("all_int"), F.bit_and("fmt_mask").alias("fmt_mask"), seen.alias("first"))
    return found.select("endpoint", "status", shapes.shown(F.col("path")).alias("path"), "family", "samples", "all_int", "fmt_mask", "first.first_ord", "first.first_pos")


def keep_nodes(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's changed nodes under the batch's number, so a repeated batch replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return node_counts(stream).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
