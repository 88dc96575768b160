"""Capped, ROI-gated retention policies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.columns import clamp
from brindle.operators.ordered import quantiles, with_global_index


@dataclass(frozen=True)
class InterventionConfig:
    risk_high: float = 0.70
    risk_mid: float = 0.40
    ltv_high: float = 0.80
    ltv_mid: float = 0.50
    discount_factor: float = 0.70
    content_factor: float = 0.85
    email_factor: float = 0.92
    discount_share: float = 0.20
    price: float = 15.49
    discount_months: int = 2
    margin: float = 0.10
    cap_discount: int = 25_000
    cap_content: int = 50_000
    cap_email: int = 100_000

    @property
    def discount_cost(self) -> float:
        return self.discount_share * self.price * self.discount_months


def initial_policy(risk: DataFrame, cfg: InterventionConfig = InterventionConfig()) -> DataFrame:
    """``risk`` with risk_tier, ltv_tier and intervention; per action only the first ``cap`` users by risk keep it.

    Places within an action come from one global order, so a large action is not one task's.
    """
    cuts = quantiles(risk, {"high": ("ltv_usd", cfg.ltv_high), "mid": ("ltv_usd", cfg.ltv_mid)})
    p, ltv = F.col("p_churn"), F.col("ltv_usd")
    rows = risk.withColumn("risk_tier", F.when(p >= cfg.risk_high, "high").when(p >= cfg.risk_mid, "mid").otherwise("low"))
    rows = rows.withColumn("ltv_tier", F.when(ltv >= F.lit(cuts["high"]), "high").when(ltv >= F.lit(cuts["mid"]), "mid").otherwise("low"))
    high = F.col("risk_tier") == "high"
    action = F.when(high & (F.col("ltv_tier") == "high"), "discount_2mo").when(high, "content_boost").when(F.col("risk_tier") == "mid", "email_nudge").otherwise("none")
    rows = rows.withColumn("intervention", action).withColumns({"__r": -F.col("revenue_at_risk_usd"), "__p": -p})
    rows = with_global_index(rows, "intervention", "__r", "__p", "user_id", name="__at").drop("__r", "__p")
    first = rows.groupBy("intervention").agg(F.min("__at").alias("__first"))  # four rows
    cap = F.when(F.col("intervention") == "discount_2mo", cfg.cap_discount).when(F.col("intervention") == "content_boost", cfg.cap_content).when(F.col("intervention") == "email_nudge", cfg.cap_email)
    rows = rows.join(F.broadcast(first), "intervention").withColumn("intervention", F.when(F.col("__at") - F.col("__first") < cap, F.col("intervention")).otherwise("none"))
    return rows.drop("__at", "__first")


def intervention_effects(policy: DataFrame, cfg: InterventionConfig = InterventionConfig()) -> DataFrame:
    """Probability, risk, cost and net value after the action; single precision, differences taken in double."""
    a = F.col("intervention")
    factor = F.when(a == "discount_2mo", cfg.discount_factor).when(a == "content_boost", cfg.content_factor).when(a == "email_nudge", cfg.email_factor).otherwise(1.0)
    p_new = clamp(F.col("p_churn") * factor, 0.0, 1.0)
    risk_new = F.col("ltv_usd") * p_new
    cost = F.when(a == "discount_2mo", cfg.discount_cost).otherwise(0.0)
    reduction = F.col("revenue_at_risk_usd") - risk_new
    new = {"p_churn_new": p_new, "revenue_at_risk_new_usd": risk_new, "intervention_cost_usd": cost, "risk_reduction_usd": reduction, "net_value_usd": reduction - cost}
    return policy.withColumns({k: v.cast("float") for k, v in new.items()})


def roi_gated(effects: DataFrame, cfg: InterventionConfig = InterventionConfig()) -> DataFrame:
    """Discounts that bring less than their cost and margin become content boosts (beyond their cap, if need be)."""
    poor = (F.col("intervention") == "discount_2mo") & (F.col("risk_reduction_usd").cast("double") < F.col("intervention_cost_usd").cast("double") * (1 + cfg.margin))
    return intervention_effects(effects.withColumn("intervention", F.when(poor, "content_boost").otherwise(F.col("intervention"))), cfg)


def simulate_interventions(risk: DataFrame, cfg: InterventionConfig = InterventionConfig()) -> DataFrame:
    return roi_gated(intervention_effects(initial_policy(risk, cfg), cfg), cfg)


def intervention_summary(rows: DataFrame) -> DataFrame:
    total = lambda c: F.sum(F.col(c).cast("double"))
    count = lambda a: F.count_if(F.col("intervention") == a).alias(f"n_{a}")
    return rows.agg(
        F.count("*").alias("n_users"), count("discount_2mo"), count("content_boost"), count("email_nudge"), count("none"),
        total("revenue_at_risk_usd").alias("risk_before_usd"), total("revenue_at_risk_new_usd").alias("risk_after_usd"), total("risk_reduction_usd").alias("risk_reduction_usd"),
        total("intervention_cost_usd").alias("cost_usd"), total("net_value_usd").alias("net_value_usd"),
        F.avg("p_churn").alias("avg_p_churn"), F.avg(F.col("p_churn_new").cast("double")).alias("avg_p_churn_new"),
        F.avg(F.col("risk_reduction_usd").cast("double")).alias("avg_risk_reduction_usd"), F.avg(F.col("net_value_usd").cast("double")).alias("avg_net_value_usd"),
    )

