"""The test tables as interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines: customer, part, order date, and a rating on the grid 0.5 .. 5.0 from the quantity."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    rating = (F.lit(1) + F.col("l_quantity").cast("long") % 10) * F.lit(0.5)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), rating.alias("rating"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts")
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: user, the item in the properties, value as rating."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "props", "value", "ts")
    return events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), F.col("value").alias("rating"), F.col("ts").cast("timestamp_ntz").alias("ts"))
