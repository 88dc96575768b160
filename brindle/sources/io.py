"""Sources and sinks of the pipeline's artifacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.schema import RAW_RATINGS


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw ratings (userId, movieId, rating, timestamp in epoch seconds) as interactions; malformed rows raise."""
    raw = spark.read.schema(RAW_RATINGS).option("header", True).option("mode", "FAILFAST").csv(path)
    return normalize_ratings(raw)


def normalize_ratings(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("userId").cast("long").alias("user_id"), F.col("movieId").cast("long").alias("item_id"), F.col("rating").cast("double").alias("rating"),
        F.timestamp_seconds("timestamp").cast("timestamp_ntz").alias("ts"),
    )


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_optional(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or an empty one of ``schema`` where there is none."""
    if path:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), order_by: tuple[str, ...] = (), files: int | None = None) -> None:
    """Replace ``path`` by ``df`` as zstd Parquet. ``order_by``: range-partitioned and sorted; ``files``: compacted into so many."""
    if order_by:
        df = df.repartitionByRange(files, *order_by).sortWithinPartitions(*order_by) if files else df.orderBy(*order_by)
    elif files:
        df = df.repartition(files)
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_splits(labeled: DataFrame, path: str, metadata: dict | None = None) -> None:
    """One write of a labeled table, a folder for each split, with the metadata beside it, in the same store."""
    write_parquet(labeled, path, partition_by=("split",))
    if metadata is not None:
        write_json(labeled.sparkSession, metadata, f"{path.rstrip('/')}.metadata.json")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file in any store that Spark reads."""
    return spark.read.text(path, wholetext=True).first()["value"]


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small file of the driver's, replaced as a whole, folders included, in any store that Hadoop writes to."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """A small document of the driver's, keys sorted."""
    write_text(spark, json.dumps(document, indent=2, sort_keys=True, default=str), path)


def write_ratings_csv(interactions: DataFrame, path: str) -> None:
    """Interactions as raw ratings, whole seconds: the inverse of :func:`read_ratings_csv`."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    raw = interactions.select(F.col("user_id").alias("userId"), F.col("item_id").alias("movieId"), "rating", seconds.alias("timestamp"))
    raw.write.mode("overwrite").option("header", True).csv(path)
