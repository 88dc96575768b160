"""Ranking metrics at several cutoffs in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS = (5, 10, 20, 50)
NAMES = ("precision", "recall", "hit_rate", "ndcg", "map")


def _ranked(topk: DataFrame) -> DataFrame:
    """Each user's list, numbered from 1 by rank, or by item where there is no rank."""
    order = Window.partitionBy("user_id").orderBy(*(["rank"] if "rank" in topk.columns else []), "item_id")
    return topk.select("user_id", "item_id", F.row_number().over(order).alias("at"))


def user_metrics(topk: DataFrame, truth: DataFrame, ks: tuple[int, ...] = KS, fixed_k: bool = False) -> DataFrame:
    """(user_id, k, precision, recall, hit_rate, ndcg, map) of users on both sides.

    ``fixed_k``: precision over k, else over the items returned. Repeated truth counts once. NDCG
    and average precision are held against min(truths, k) hits.
    """
    truth = truth.select("user_id", "item_id").distinct()
    n_truth = truth.groupBy("user_id").agg(F.count("*").alias("n_truth"))
    rows = _ranked(topk).where(F.col("at") <= max(ks)).join(n_truth, "user_id")
    rows = rows.join(truth.withColumn("hit", F.lit(1)), ["user_id", "item_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    so_far = F.sum("hit").over(Window.partitionBy("user_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("ap", F.col("hit") * so_far / F.col("at")).withColumn("gain", F.col("hit") / F.log2(F.col("at") + F.lit(1.0)))
    rows = rows.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where("at <= k")
    g = rows.groupBy("user_id", "k").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"), F.sum("gain").alias("dcg"), F.sum("ap").alias("ap"), F.max("n_truth").alias("n_truth"))
    best = F.least("n_truth", F.col("k").cast("long"))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), best), F.lit(0.0), lambda a, r: a + F.lit(1.0) / F.log2(r + F.lit(1.0)))
    return g.select(
        "user_id", "k", (F.col("hits") / (F.col("k") if fixed_k else F.col("n"))).alias("precision"), (F.col("hits") / F.col("n_truth")).alias("recall"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"), (F.col("dcg") / ideal).alias("ndcg"), (F.col("ap") / best).alias("map"),
    )


def evaluate_topk(topk: DataFrame, truth: DataFrame, ks: tuple[int, ...] = KS, fixed_k: bool = False) -> DataFrame:
    """(k, n_users_eval, precision, recall, hit_rate, ndcg, map): macro means; zeros where no user is on both sides."""
    means = user_metrics(topk, truth, ks, fixed_k).groupBy("k").agg(F.count("*").alias("n_users_eval"), *(F.avg(m).alias(m) for m in NAMES))
    all_k = topk.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    return all_k.join(means, "k", "left").na.fill(0)


def as_report(metrics: DataFrame, hit_name: str = "hit_rate") -> dict[str, float]:
    """Flat ``metric@k`` map of an evaluation; one row a cutoff comes to the driver."""
    rows = metrics.collect()
    out: dict[str, float] = {"n_users_eval": rows[0]["n_users_eval"] if rows else 0}
    for r in rows:
        out |= {f"{hit_name if m == 'hit_rate' else m}@{r['k']}": r[m] for m in NAMES}
    return out


def coverage(topk: DataFrame) -> DataFrame:
    """One row: users and items recommended."""
    return topk.agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"))
