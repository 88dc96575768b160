"""User, item and interaction features of the train split, as of its last time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.columns import days_between
from brindle.operators.splits import ORDER


@dataclass(frozen=True)
class FeatureConfig:
    short_days: int = 7
    long_days: int = 30


def clock(train: DataFrame) -> DataFrame:
    """One row: the last time seen."""
    return train.agg(F.max("ts").alias("asof"))


def _recent(days: int) -> Column:
    return F.count_if(F.col("ts") >= F.col("asof") - F.make_dt_interval(F.lit(days)))


def user_features(train: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """One row a user, 15 columns. Gaps between interactions fall back to the span where there is none.

    Gaps, and the first rows of each day and item (which make distinct counts plain sums), come from
    windows over the user's rows, whose partitioning the grouping reuses: one shuffle.
    """
    mine = Window.partitionBy("user_id")
    first = lambda c, over: (c.isNotNull() & ~F.coalesce(c == F.lag(c).over(over), F.lit(False))).cast("long")
    rows = train.withColumn("gap", days_between(F.lag("ts").over(mine.orderBy(*ORDER)), F.col("ts")))
    rows = rows.withColumn("new_day", first(F.to_date("ts"), mine.orderBy(*ORDER))).withColumn("new_item", first(F.col("item_id"), mine.orderBy("item_id")))
    rows = rows.crossJoin(F.broadcast(clock(train)))  # one row
    g = rows.groupBy("user_id").agg(
        F.count("*").alias("n_interactions"), F.sum("new_item").alias("n_items"), F.avg("rating").alias("rating_mean"),
        F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("rating_std"), F.min("rating").alias("rating_min"), F.max("rating").alias("rating_max"),
        F.sum("new_day").alias("active_days"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("asof").alias("asof"),
        F.avg("gap").alias("gap_mean"), F.percentile("gap", F.lit(0.5)).alias("gap_median"),
        _recent(cfg.short_days).alias("n_last_7d"), _recent(cfg.long_days).alias("n_last_30d"),
    )
    span = days_between(F.col("first"), F.col("last"))
    return g.select(
        "user_id", "n_interactions", "n_items", (F.col("n_items") / F.col("n_interactions")).alias("item_diversity"), "rating_mean", "rating_std", "rating_min", "rating_max",
        "active_days", span.alias("span_days"), days_between(F.col("last"), F.col("asof")).alias("days_since_last"),
        F.coalesce("gap_mean", span).alias("avg_gap_days"), F.coalesce("gap_median", span).alias("median_gap_days"), "n_last_7d", "n_last_30d",
    )


def item_features(train: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """One row an item, 11 columns, in one aggregation."""
    g = train.crossJoin(F.broadcast(clock(train))).groupBy("item_id").agg(  # one row
        F.count("*").alias("n_interactions"), F.countDistinct("user_id").alias("n_users"), F.avg("rating").alias("rating_mean"),
        F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("rating_std"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("asof").alias("asof"),
        _recent(cfg.short_days).alias("n_last_7d"), _recent(cfg.long_days).alias("n_last_30d"),
    )
    return g.select(
        "item_id", "n_interactions", "n_users", "rating_mean", "rating_std", "first_ts", "last_ts", days_between(F.col("last_ts"), F.col("asof")).alias("days_since_last"),
        "n_last_7d", "n_last_30d", (F.col("n_last_30d") / F.col("n_interactions")).alias("recent_share_30d"),
    )


def interaction_features(train: DataFrame) -> DataFrame:
    """Every train row with its rating's z-score within the user (deviation 1 where it is null or 0) and its age."""
    mine = Window.partitionBy("user_id")
    sd = F.stddev_samp("rating").over(mine)
    rows = train.withColumn("mean", F.avg("rating").over(mine)).withColumn("sd", F.when(sd.isNull() | (sd == 0), 1.0).otherwise(sd))
    rows = rows.crossJoin(F.broadcast(clock(train)))  # one row
    return rows.select("user_id", "item_id", "rating", "ts", ((F.col("rating") - F.col("mean")) / F.col("sd")).alias("rating_z_user"), days_between(F.col("ts"), F.col("asof")).alias("age_days"))
