"""Leakage-safe chronological splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.ordered import with_global_index

ORDER = ("ts", "item_id", "rating")


@dataclass(frozen=True)
class SplitConfig:
    train_frac: float = 0.70
    val_frac: float = 0.15
    min_interactions: int = 5

    def __post_init__(self) -> None:
        if not 0 < self.train_frac < 1 or not 0 <= self.val_frac < 1 or self.train_frac + self.val_frac >= 1 or self.min_interactions < 1:
            raise ValueError(f"invalid split: {self}")


def _ends(n: str, cfg: SplitConfig, exact: bool) -> tuple:
    """Last places of train and val among ``n``; ``exact`` multiplies by decimals, else by doubles."""
    both = cfg.train_frac + cfg.val_frac
    part = lambda f: F.expr(f"CAST(floor({n} * {f'{f:.10g}BD' if exact else f'{f!r}D'}) AS BIGINT)")
    train = F.greatest(F.lit(1).cast("long"), part(cfg.train_frac))
    return train, F.greatest(train, part(both))


def split_per_user(interactions: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """The input with ``split``: each user's rows by (ts, item, rating), the first share to train, the next to val.

    Users of fewer than ``min_interactions`` rows are all train. Rows equal in all columns are
    interchangeable. No rows: no rows.
    """
    mine = Window.partitionBy("user_id")
    ranked = interactions.withColumn("__n", F.count("*").over(mine)).withColumn("__at", F.row_number().over(mine.orderBy(*ORDER)))
    train, val = _ends("__n", cfg, exact=True)
    label = F.when(F.col("__n") < cfg.min_interactions, "train").when(F.col("__at") <= train, "train").when(F.col("__at") <= val, "val").otherwise("test")
    return ranked.withColumn("split", label).drop("__n", "__at")


def split_global(interactions: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """The input with ``split``: cuts at two places of the order (ts, user, item, rating) over all rows."""
    placed = with_global_index(interactions, "ts", "user_id", "item_id", "rating", name="__at")
    total = interactions.agg(F.count("*").alias("__n"))
    train, val = _ends("__n", cfg, exact=False)
    label = F.when(F.col("__at") <= train, "train").when(F.col("__at") <= val, "val").otherwise("test")
    return placed.crossJoin(F.broadcast(total)).withColumn("split", label).drop("__at", "__n")  # one row


def split_metadata(labeled: DataFrame) -> DataFrame:
    """One row: n_total, n_train, n_val, n_test and the shares (0 without rows)."""
    counts = labeled.agg(F.count("*").alias("n_total"), *(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")))
    share = lambda s: F.coalesce(F.col(f"n_{s}") / F.nullif(F.col("n_total"), F.lit(0)), F.lit(0.0)).alias(f"frac_{s}")
    return counts.select("*", *(share(s) for s in ("train", "val", "test")))


def _spans(labeled: DataFrame) -> DataFrame:
    at = lambda s: F.when(F.col("split") == s, F.col("ts"))
    return labeled.groupBy("user_id").agg(F.max(at("train")).alias("train_max"), F.min(at("val")).alias("val_min"), F.max(at("val")).alias("val_max"), F.min(at("test")).alias("test_min"))


def leakage_violations(labeled: DataFrame) -> DataFrame:
    """Users whose train reaches past their val, or val past their test; a user without val is not compared."""
    return _spans(labeled).where((F.col("train_max") > F.col("val_min")) | (F.col("val_max") > F.col("test_min")))


def order_violations(labeled: DataFrame) -> DataFrame:
    """As :func:`leakage_violations`, for users with train rows, and train against test where val is empty."""
    last = F.coalesce("val_max", "train_max")
    return _spans(labeled).where(F.col("train_max").isNotNull() & ((F.col("train_max") > F.col("val_min")) | (last > F.col("test_min"))))


def validate_per_user_order(labeled: DataFrame) -> None:
    n = order_violations(labeled).count()
    if n:
        raise ValueError(f"{n} users out of order")


def splits(labeled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(labeled.where(F.col("split") == s).drop("split") for s in ("train", "val", "test"))


def overlaps(labeled: DataFrame) -> DataFrame:
    """(user_id, item_id, rating, ts, n_splits) of rows that stand in more than one split: none, where rows do not repeat."""
    g = labeled.groupBy("user_id", "item_id", "rating", "ts").agg(F.countDistinct("split").alias("n_splits"))
    return g.where("n_splits > 1")
