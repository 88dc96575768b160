"""Churn labels, model and its exact rank metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.columns import clamp, epoch_micros
from brindle.operators.ordered import quantiles, running_totals, with_global_index
from brindle.scratch import materialize


@dataclass(frozen=True)
class ChurnConfig:
    """``exclude_recency`` leaves out ``days_since_last``, which all but states the label."""

    inactivity_days: float = 90.0
    fallback_share: float = 0.20
    c: float = 1.0
    max_iter: int = 2000
    train_share: float = 0.8
    exclude_recency: bool = False


def inactivity(interactions: DataFrame) -> DataFrame:
    """(user_id, inactivity_days): days with fractions from a user's last time to the last of all."""
    last = interactions.groupBy("user_id").agg(F.max("ts").alias("last"))
    end = interactions.agg(F.max("ts").alias("end"))
    return last.crossJoin(F.broadcast(end)).select("user_id", ((epoch_micros(F.col("end")) - epoch_micros(F.col("last"))) / F.lit(86400e6)).alias("inactivity_days"))  # one row


def churn_labels(interactions: DataFrame, cfg: ChurnConfig = ChurnConfig()) -> DataFrame:
    return inactivity(interactions).withColumn("label", (F.col("inactivity_days") >= cfg.inactivity_days).cast("int"))


def fallback_labels(labels: DataFrame, cfg: ChurnConfig = ChurnConfig()) -> DataFrame:
    """The top share by inactivity as label 1: those at or above the exact interpolated quantile."""
    cut = quantiles(labels, {"cut": ("inactivity_days", 1 - cfg.fallback_share)})["cut"]
    return labels.withColumn("label", (F.col("inactivity_days") >= F.lit(cut)).cast("int"))


def two_class_labels(interactions: DataFrame, cfg: ChurnConfig = ChurnConfig()) -> DataFrame:
    labels = churn_labels(interactions, cfg)
    kinds = labels.agg(F.min("label"), F.max("label")).first()
    if kinds[0] != kinds[1]:
        return labels
    labels = fallback_labels(labels, cfg)
    kinds = labels.agg(F.min("label"), F.max("label")).first()
    if kinds[0] == kinds[1]:
        raise ValueError("all users are equally inactive: no second class")
    return labels


def feature_columns(df: DataFrame, cfg: ChurnConfig = ChurnConfig()) -> list[str]:
    """Numeric columns that are no ids, labels or inactivity."""
    skip = {"label", "inactivity_days", *(["days_since_last"] if cfg.exclude_recency else [])}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip and not f.name.endswith("_id")]


def churn_matrix(features: DataFrame, labels: DataFrame, cfg: ChurnConfig = ChurnConfig()) -> tuple[DataFrame, list[str]]:
    """((user_id, label, part, one column a feature), feature names): users of both tables, the first share by id to train.

    Missing values take the training median; columns are scaled by the training mean and population
    deviation (1 where it is 0).
    """
    columns = feature_columns(features, cfg)
    rows = with_global_index(features.join(labels.select("user_id", "label"), "user_id"), "user_id", name="at")
    n = rows.count()
    rows = rows.withColumn("part", F.when(F.col("at") <= int(cfg.train_share * n), "train").otherwise("val"))
    train = rows.where("part = 'train'")
    medians = quantiles(train, {c: (c, 0.5) for c in columns}) if columns else {}
    fill = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c] or 0.0)))
    moments = train.agg(F.count("*").alias("n"), *(x for c in columns for x in (F.avg(fill(c)).alias(f"m_{c}"), F.stddev_pop(fill(c)).alias(f"s_{c}")))).first()
    scaled = [((fill(c) - F.lit(moments[f"m_{c}"] or 0.0)) / F.lit(moments[f"s_{c}"] or 1.0)).alias(c) for c in columns]
    return rows.select("user_id", "label", "part", *scaled), columns


def train_and_score(features: DataFrame, labels: DataFrame, cfg: ChurnConfig = ChurnConfig()) -> tuple[DataFrame, dict]:
    """((user_id, churn_prob, label, part), report): balanced L2 logistic regression, fitted on the first users by id.

    The penalty 1 / (C n) makes the objective that of C-weighted losses with balanced classes. The
    report evaluates the model on the other users: churn_rate (of all), roc_auc and pr_auc (null
    where those are of one class).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    matrix, columns = churn_matrix(features, labels, cfg)
    matrix = materialize(matrix, "churn-matrix")
    of = {r["part"]: r for r in matrix.groupBy("part").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).collect()}  # two rows
    n, ones = of["train"]["n"], of["train"]["ones"]
    weight = F.when(F.col("label") == 1, n / (2.0 * max(ones, 1))).otherwise(n / (2.0 * max(n - ones, 1)))
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(matrix.withColumn("weight", weight))
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1.0 / (cfg.c * n), elasticNetParam=0.0, standardization=False, maxIter=cfg.max_iter, tol=1e-10)
    model = lr.fit(vectors.where("part = 'train'"))
    prob = clamp(F.get(vector_to_array("probability"), F.lit(1)), 0.0, 1.0).cast("float")
    scored = materialize(model.transform(vectors).select("user_id", prob.alias("churn_prob"), "label", "part"), "churn-scores")
    total = sum(r["n"] for r in of.values())
    val = auc(scored.where("part = 'val'")).first()
    report = {"n_users": total, "n_features": len(columns), "proxy": "inactivity", "churn_rate": sum(r["ones"] for r in of.values()) / total, "roc_auc": val["roc_auc"], "pr_auc": val["pr_auc"]}
    return scored, report


def auc(scored: DataFrame, score: str = "churn_prob", label: str = "label") -> DataFrame:
    """One row: n_users, churn_rate, roc_auc (null with one class), pr_auc (trapezoids from recall 0 at precision 1).

    Ties are grouped first; running sums go over distinct scores, in ranges of them.
    """
    g = scored.groupBy((-F.col(score)).alias("s")).agg(F.sum(label).cast("long").alias("ones"), F.count("*").alias("n"))
    tot = scored.agg(F.sum(label).alias("p"), F.count("*").alias("total"))
    r = running_totals(g, "s", tp=F.col("ones"), seen=F.col("n")).crossJoin(F.broadcast(tot))  # one row
    zeros = F.col("n") - F.col("ones")
    recall, precision = F.col("tp") / F.nullif("p", F.lit(0)), F.col("tp") / F.col("seen")
    before = F.col("seen") - F.col("n")
    r0 = (F.col("tp") - F.col("ones")) / F.nullif("p", F.lit(0))
    p0 = F.when(before > 0, (F.col("tp") - F.col("ones")) / F.nullif(before, F.lit(0))).otherwise(1.0)
    # Pairs (one, zero) in right order: zeros below, and half of those that tie.
    wins = F.sum(F.col("ones") * (F.col("total") - F.col("p") - (F.col("seen") - F.col("tp")) + zeros / 2.0))
    return r.agg(
        F.max("total").alias("n_users"), (F.max("p") / F.max("total")).alias("churn_rate"), (wins / F.nullif(F.max("p") * (F.max("total") - F.max("p")), F.lit(0))).alias("roc_auc"),
        F.sum((recall - r0) * (precision + p0) / 2.0).alias("pr_auc"),
    )
