"""Incremental ingestion: new CSV files become Parquet shards, each file once, in bounded micro-batches."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from brindle.schema import RAW_RATINGS
from brindle.sources.io import normalize_ratings


def ingest_ratings(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Append the ratings of all CSV files not yet seen to ``target``, then end; exactly once by the checkpoint."""
    raw = spark.readStream.schema(RAW_RATINGS).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(source)
    writer = normalize_ratings(raw).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).option("compression", "zstd")
    return writer.trigger(availableNow=True).start()
