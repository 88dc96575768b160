"""Item-item similarity graph from co-occurrence."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GraphConfig:
    """``norm``: degrees are all train rows of an item (``interactions``; deflated, as its numerator counts capped users only) or its capped users (``users``; a true cosine)."""

    min_support: int = 200
    min_cooc: int = 20
    topk: int = 100
    min_cosine: float = 0.10
    min_items: int = 2
    max_items: int = 300
    norm: str = "users"
    tiny: int = 50


def tuned(train: DataFrame, cfg: GraphConfig) -> GraphConfig:
    """``cfg`` relaxed where rows, users or items are ``tiny`` or fewer."""
    n = train.agg(F.count("*").alias("rows"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items")).first()
    if min(n) > cfg.tiny:
        return cfg
    return replace(cfg, min_support=1, min_cooc=1, min_items=1, topk=max(1, min(cfg.topk, n["items"] - 1)), min_cosine=0.0)


def item_support(train: DataFrame, cfg: GraphConfig) -> DataFrame:
    """(item_id, support): rows of the items that have enough."""
    return train.groupBy("item_id").agg(F.count("*").alias("support")).where(F.col("support") >= cfg.min_support)


def capped_user_items(train: DataFrame, cfg: GraphConfig) -> DataFrame:
    """Distinct (user_id, item_id) over supported items, of users with neither too few nor too many."""
    pairs = train.select("user_id", "item_id").join(item_support(train, cfg), "item_id", "left_semi").distinct()
    return pairs.withColumn("n", F.count("*").over(Window.partitionBy("user_id"))).where(F.col("n").between(cfg.min_items, cfg.max_items)).drop("n")


def cooccurrence(user_items: DataFrame, cfg: GraphConfig) -> DataFrame:
    """(i, j, cooc_cnt) with i < j: users that have both. Capped users bound the pairs to a constant times the users."""
    a, b = user_items.select("user_id", F.col("item_id").alias("i")), user_items.select("user_id", F.col("item_id").alias("j"))
    return a.join(b, "user_id").where("i < j").groupBy("i", "j").agg(F.count("*").alias("cooc_cnt")).where(F.col("cooc_cnt") >= cfg.min_cooc)


def item_edges(train: DataFrame, cfg: GraphConfig = GraphConfig()) -> DataFrame:
    """(src_item, dst_item, cosine, cooc_cnt, src_cnt, dst_cnt), both directions, above the least cosine."""
    pairs = capped_user_items(train, cfg)
    degree = item_support(train, cfg) if cfg.norm == "interactions" else pairs.groupBy("item_id").agg(F.count("*").alias("support"))
    end = lambda k: degree.select(F.col("item_id").alias(k), F.col("support").alias(f"{k}_cnt"))
    e = cooccurrence(pairs, cfg).join(end("i"), "i").join(end("j"), "j")
    e = e.withColumn("cosine", F.col("cooc_cnt") / F.sqrt(F.col("i_cnt") * F.col("j_cnt").cast("double"))).where(F.col("cosine") >= cfg.min_cosine)
    way = lambda s, d: F.struct(F.col(s).alias("src_item"), F.col(d).alias("dst_item"), F.col(f"{s}_cnt").alias("src_cnt"), F.col(f"{d}_cnt").alias("dst_cnt"))
    e = e.select("cosine", "cooc_cnt", F.explode(F.array(way("i", "j"), way("j", "i"))).alias("e"))
    return e.select("e.src_item", "e.dst_item", "cosine", "cooc_cnt", "e.src_cnt", "e.dst_cnt")


def topk_neighbors(edges: DataFrame, topk: int) -> DataFrame:
    """The ``topk`` best neighbours of each item, ranked by cosine, co-occurrence, then id."""
    order = Window.partitionBy("src_item").orderBy(F.desc("cosine"), F.desc("cooc_cnt"), "dst_item")
    return edges.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= topk)


def build_graph(train: DataFrame, cfg: GraphConfig = GraphConfig(), auto_tune: bool = True) -> DataFrame:
    cfg = tuned(train, cfg) if auto_tune else cfg
    return topk_neighbors(item_edges(train, cfg), cfg.topk)
