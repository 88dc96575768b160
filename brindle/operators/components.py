"""Connected components and the clusters that the item graph falls into."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.ordered import with_global_index
from brindle.scratch import drop, materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node id reachable.

    Alternating large-star and small-star (Kiveris et al., 2014): each step is one partial
    aggregation and one equi-join on the node, so a hub with many edges is combined before it is
    shuffled and its join partition can be split by AQE. Every round is written to the shared
    folder. Rounds go on until one changes nothing (their number is logarithmic). Self loops, repeated and null edges are ignored; no edges give an empty result.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = materialize(e.where("u > v").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        new = materialize(small.where("u > v").distinct(), "edges", rows=2 * before[0])
        after = mark(new)
        drop(e)
        e = new
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


@dataclass(frozen=True)
class ClusterConfig:
    min_cosine: float = 0.12
    min_cooc: int = 10
    min_size: int = 20


def connected_item_clusters(edges: DataFrame, cfg: ClusterConfig = ClusterConfig()) -> DataFrame:
    """(item_id, cluster_id, cluster_size): components of the thresholded graph of ``min_size`` items or more.

    Ids run from 0 by falling size, then by smallest item. Numbering sorts clusters, not items, in ranges.
    """
    kept = edges.where((F.col("cosine") >= cfg.min_cosine) & (F.col("cooc_cnt") >= cfg.min_cooc))
    parts = connected_components(kept, "src_item", "dst_item")
    sizes = parts.groupBy("component").agg(F.count("*").alias("cluster_size")).where(F.col("cluster_size") >= cfg.min_size)
    sizes = with_global_index(sizes.withColumn("down", -F.col("cluster_size")), "down", "component", name="at")
    sizes = sizes.select("component", "cluster_size", (F.col("at") - 1).alias("cluster_id"))
    return parts.join(sizes, "component").select(F.col("node").alias("item_id"), "cluster_id", "cluster_size")


def dense_item_clusters(items: DataFrame) -> DataFrame:
    """(item_id, cluster_id): each distinct item its own cluster, numbered in item order.

    Numbers come from counts of id ranges, so no task holds all items.
    """
    ids = items.select("item_id").where("item_id is not null").distinct()
    return with_global_index(ids, "item_id", name="at").select("item_id", (F.col("at") - 1).alias("cluster_id"))
