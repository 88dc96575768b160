"""Lifetime value and revenue at risk."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.columns import clamp
from brindle.operators.churn import inactivity
from brindle.operators.ordered import with_global_index
from brindle.schema import CHURN_COLUMNS, first_present


@dataclass(frozen=True)
class LtvConfig:
    price: float = 15.49
    min_months: int = 1
    max_months: int = 24
    top_share: float = 0.02


def user_ltv(interactions: DataFrame, cfg: LtvConfig = LtvConfig()) -> DataFrame:
    """(user_id, n_interactions, n_distinct_items, recency_days, expected_months, ltv_usd)."""
    g = interactions.groupBy("user_id").agg(F.count("*").alias("n_interactions"), F.countDistinct("item_id").alias("n_distinct_items"))
    g = g.join(inactivity(interactions).withColumnRenamed("inactivity_days", "recency_days"), "user_id")
    # Fixed values of the proxy.
    months = 2.0 + 1.2 * F.log1p("n_interactions") + 0.8 * F.log1p("n_distinct_items") - 0.08 * F.col("recency_days")
    months = clamp(F.round(months), float(cfg.min_months), float(cfg.max_months)).cast("long")
    return g.withColumn("expected_months", months).withColumn("ltv_usd", (F.col("expected_months") * F.lit(Decimal(str(cfg.price)))).cast("double"))


def revenue_risk(churn: DataFrame, ltv: DataFrame) -> DataFrame:
    """Users with both a churn probability (under any of its names) and a value: risk and its bucket."""
    name = first_present(churn.columns, CHURN_COLUMNS)
    rows = churn.select("user_id", F.col(name).cast("double").alias("p_churn")).join(ltv, "user_id")
    risk = F.col("p_churn") * F.col("ltv_usd")
    bucket = F.when(risk >= 100, "critical").when(risk >= 50, "high").when(risk >= 20, "medium").otherwise("low")
    return rows.select("user_id", "p_churn", "ltv_usd", risk.alias("revenue_at_risk_usd"), "expected_months", "n_interactions", "n_distinct_items", "recency_days", bucket.alias("risk_bucket"))


def revenue_risk_top(risk: DataFrame, cfg: LtvConfig = LtvConfig()) -> DataFrame:
    """The first ceil(share * n) users by risk, probability, value, then id; with place ``rn`` and ``n``."""
    ranked = risk.withColumns({"a": -F.col("revenue_at_risk_usd"), "b": -F.col("p_churn"), "c": -F.col("ltv_usd")})
    ranked = with_global_index(ranked, "a", "b", "c", "user_id", name="rn").drop("a", "b", "c")
    total = risk.agg(F.count("*").alias("n"))
    share = F.lit(Decimal(str(cfg.top_share)))
    return ranked.crossJoin(F.broadcast(total)).where(F.col("rn") <= F.ceil(F.col("n") * share))  # one row


def revenue_risk_summary(risk: DataFrame) -> DataFrame:
    high = F.when(F.col("risk_bucket").isin("high", "critical"), F.col("revenue_at_risk_usd")).otherwise(0.0)
    return risk.agg(
        F.count("*").alias("n_users"), F.avg("p_churn").alias("avg_p_churn"), F.avg("ltv_usd").alias("avg_ltv_usd"),
        F.sum("revenue_at_risk_usd").alias("total_revenue_at_risk_usd"), F.sum(high).alias("high_critical_risk_usd"),
    )
