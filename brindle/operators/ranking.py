"""Top-K recommendations from the item graph, with a popularity fallback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RankerConfig:
    """``exclude_seen``: also leave seen items out of the fallback, and items beyond the capped history (off: as the reference results have it)."""

    k: int = 50
    candidates: int = 300
    min_rating: float = 4.0
    history: int = 200
    min_history: int = 5
    w_graph: float = 1.0
    w_pop: float = 0.15
    exclude_seen: bool = False


def popularity(train: DataFrame) -> DataFrame:
    """(item_id, popularity): log10(1 + rows)."""
    return train.groupBy("item_id").agg(F.log10(F.count("*") + F.lit(1.0)).alias("popularity"))


def user_history(train: DataFrame, cfg: RankerConfig = RankerConfig()) -> DataFrame:
    """(user_id, item_id, rating): each user's best rows at or above the least rating; repeated items stay."""
    order = Window.partitionBy("user_id").orderBy(F.desc("rating"), "item_id")
    liked = train.where(F.col("rating") >= cfg.min_rating).select("user_id", "item_id", "rating")
    return liked.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cfg.history).drop("rn")


def eligible_users(train: DataFrame, val: DataFrame, history: DataFrame) -> DataFrame:
    """(user_id, n_hist): every user of train or val with the size of their history."""
    users = train.select("user_id").unionByName(val.select("user_id")).distinct()
    n = history.groupBy("user_id").agg(F.count("*").alias("n_hist"))
    return users.join(n, "user_id", "left").select("user_id", F.coalesce("n_hist", F.lit(0).cast("long")).alias("n_hist"))


def popularity_fallback(pop: DataFrame, cfg: RankerConfig = RankerConfig()) -> DataFrame:
    """The most popular items: at most ``cfg.candidates`` rows."""
    return pop.orderBy(F.desc("popularity"), "item_id").limit(cfg.candidates)


def unseen_candidates(history: DataFrame, graph: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, mass): summed cosine from the history, without items of the history (or of ``seen``)."""
    edges = graph.select(F.col("src_item").alias("item_id"), "dst_item", "cosine")
    mass = history.select("user_id", "item_id").join(edges, "item_id").groupBy("user_id", F.col("dst_item").alias("item_id")).agg(F.sum("cosine").alias("mass"))
    return mass.join((seen if seen is not None else history).select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def graph_candidates(history: DataFrame, graph: DataFrame, pop: DataFrame, cfg: RankerConfig = RankerConfig(), seen: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, score): the best candidates of each user by mass and popularity.

    Scores are rounded to nine places, so that the order of summation cannot change a rank.
    """
    rows = unseen_candidates(history, graph, seen).join(pop, "item_id", "left")
    rows = rows.select("user_id", "item_id", F.round(F.col("mass") * cfg.w_graph + F.coalesce("popularity", F.lit(0.0)) * cfg.w_pop, 9).alias("score"))
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cfg.candidates).drop("rn")


def recommend(train: DataFrame, val: DataFrame, graph: DataFrame | None, cfg: RankerConfig = RankerConfig()) -> DataFrame:
    """(user_id, item_id, score, rank), rank <= k.

    Users of fewer than ``min_history`` liked rows get the popular items; the others their graph
    candidates, which may be none. Without a graph all get the popular items.
    """
    pop, history = popularity(train), user_history(train, cfg)
    users = eligible_users(train, val, history)
    top = popularity_fallback(pop, cfg).select("item_id", F.col("popularity").alias("score"))
    few = users.where(F.col("n_hist") < cfg.min_history) if graph is not None else users
    if not cfg.exclude_seen:
        top = top.orderBy(F.desc("score"), "item_id").limit(cfg.k)  # nothing is left out, so the first k are each user's
    rows = few.select("user_id").crossJoin(F.broadcast(top))  # at most cfg.candidates rows
    seen = train.select("user_id", "item_id").distinct() if cfg.exclude_seen else None
    if seen is not None:
        rows = rows.join(seen, ["user_id", "item_id"], "left_anti")
    if graph is not None:
        many = users.where(F.col("n_hist") >= cfg.min_history).select("user_id")
        pool = graph_candidates(history.join(many, "user_id", "left_semi"), graph, pop, cfg, seen)
        rows = rows.select("user_id", "item_id", "score").unionByName(pool)
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.k).select("user_id", "item_id", "score", "rank")
