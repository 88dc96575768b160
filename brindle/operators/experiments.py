"""Deterministic experiment assignment, sample size and z-tests."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import normal
from brindle.functions.columns import two_sided_p, unit_hash


@dataclass(frozen=True)
class ExperimentConfig:
    experiment_id: str = "retention_ab"
    treatment_share: float = 0.50
    discount_share: float = 0.05
    content_share: float = 0.45
    alpha: float = 0.05
    power: float = 0.80
    mde: float = 0.03
    two_sided: bool = True


def assign_variants(users: DataFrame, cfg: ExperimentConfig = ExperimentConfig()) -> DataFrame:
    u = unit_hash(F.lit(cfg.experiment_id), F.col("user_id"))
    return users.withColumn("variant", F.when(u < cfg.treatment_share, "treatment").otherwise("control"))


def assign_variants_3arm(users: DataFrame, cfg: ExperimentConfig = ExperimentConfig()) -> DataFrame:
    u = unit_hash(F.lit(cfg.experiment_id), F.col("user_id"))
    return users.withColumn("variant", F.when(u < cfg.discount_share, "discount").when(u < cfg.discount_share + cfg.content_share, "content").otherwise("control"))


def required_sample_size(mean: float, std: float, cfg: ExperimentConfig = ExperimentConfig()) -> int:
    """Users an arm needs to see a relative change of ``mde`` in a mean."""
    if mean <= 0 or std <= 0 or cfg.mde <= 0:
        raise ValueError("mean, std and mde must be positive")
    z = normal.quantile(1 - cfg.alpha / (2 if cfg.two_sided else 1)) + normal.quantile(cfg.power)
    return math.ceil(2 * (z * std / (mean * cfg.mde)) ** 2)


def outcomes(risk: DataFrame, interventions: DataFrame) -> DataFrame:
    """Every user of ``risk`` with the simulated risk, cost, action and net value; unmatched users keep their baseline."""
    new = interventions.select("user_id", F.col("revenue_at_risk_new_usd").cast("double").alias("new"), "intervention", F.col("intervention_cost_usd").cast("double").alias("cost"), F.col("net_value_usd").cast("double").alias("net"))
    rows = risk.select("user_id", "revenue_at_risk_usd").join(new, "user_id", "left")
    return rows.select("user_id", "revenue_at_risk_usd", F.coalesce("new", "revenue_at_risk_usd").alias("risk_new"), F.coalesce("intervention", F.lit("none")).alias("intervention"), F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("net", F.lit(0.0)).alias("net"))


def observed(rows: DataFrame, cfg: ExperimentConfig = ExperimentConfig()) -> DataFrame:
    """``outcomes`` with variant and ``y``: baseline risk under control, else the simulated one; control has no cost or value."""
    control = F.col("variant") == "control"
    rows = assign_variants_3arm(rows, cfg)
    return rows.withColumns({"y": F.when(control, F.col("revenue_at_risk_usd")).otherwise(F.col("risk_new")), "cost": F.when(control, 0.0).otherwise(F.col("cost")), "net": F.when(control, 0.0).otherwise(F.col("net"))})


def arm_stats(rows: DataFrame) -> DataFrame:
    """(variant, n, mean_y, var_y, cost_usd, net_value_usd)."""
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.avg("y").alias("mean_y"), F.var_samp("y").alias("var_y"), F.sum("cost").alias("cost_usd"), F.sum("net").alias("net_value_usd"))


def tests_vs_control(stats: DataFrame) -> DataFrame:
    """(variant, effect, se, z, p_value, lift) of each arm against control; z, p_value and lift null where they have no meaning."""
    c = stats.where("variant = 'control'").select(F.col("n").alias("nc"), F.col("mean_y").alias("mc"), F.col("var_y").alias("vc"))
    se = F.sqrt(F.col("var_y") / F.col("n") + F.col("vc") / F.col("nc"))
    rows = stats.where("variant <> 'control'").crossJoin(F.broadcast(c))  # one row
    rows = rows.withColumn("effect", F.col("mean_y") - F.col("mc")).withColumn("se", se)
    rows = rows.withColumn("z", F.col("effect") / F.nullif("se", F.lit(0.0)))
    return rows.select("variant", "effect", "se", "z", two_sided_p(F.col("z")).alias("p_value"), (F.col("effect") / F.nullif("mc", F.lit(0.0))).alias("lift"))


def sample_size(baseline: DataFrame, cfg: ExperimentConfig = ExperimentConfig()) -> DataFrame:
    """(n_per_arm) for one row of mean and std, as :func:`required_sample_size`; null where there is nothing to see."""
    z = normal.quantile(1 - cfg.alpha / (2 if cfg.two_sided else 1)) + normal.quantile(cfg.power)
    need = F.ceil(F.lit(2.0) * F.pow(F.lit(z) * F.col("std") / (F.col("mean") * F.lit(cfg.mde)), F.lit(2.0)))
    return baseline.select(F.when((F.col("mean") > 0) & (F.col("std") > 0), need).cast("long").alias("n_per_arm"))


def ztest(mean_x: float, var_x: float, n_x: int, mean_y: float, var_y: float, n_y: int) -> dict:
    """Difference of means of y against control x, from moments."""
    se = math.sqrt(var_x / n_x + var_y / n_y)
    effect = mean_y - mean_x
    z = effect / se if se else math.nan
    return {"effect": effect, "z": z, "p_value": normal.two_sided_p(z) if se else math.nan, "lift": effect / mean_x if mean_x else math.nan}


def experiment_report(risk: DataFrame, interventions: DataFrame, cfg: ExperimentConfig = ExperimentConfig()) -> dict:
    """Counts, design, tests and value by arm; three rows come to the driver."""
    rows = observed(outcomes(risk, interventions), cfg)
    arms = {r["variant"]: r.asDict() for r in arm_stats(rows).collect()}
    base = rows.agg(F.avg("revenue_at_risk_usd").alias("m"), F.stddev_samp("revenue_at_risk_usd").alias("s"), F.count("*").alias("n")).first()
    policy = {r["intervention"]: r["count"] for r in rows.groupBy("intervention").count().collect()}
    control = arms.get("control")
    tests = {a: ztest(control["mean_y"], control["var_y"], control["n"], s["mean_y"], s["var_y"], s["n"]) for a, s in arms.items() if a != "control" and control and min(s["n"], control["n"]) > 1}
    need = required_sample_size(base["m"], base["s"], cfg) if base["m"] and base["s"] else None
    return {
        "experiment_id": cfg.experiment_id, "n_total": base["n"], "counts": {a: s["n"] for a, s in arms.items()},
        "design": {"alpha": cfg.alpha, "power": cfg.power, "mde": cfg.mde, "baseline_mean": base["m"], "baseline_std": base["s"], "n_per_arm": need},
        "tests_vs_control": tests, "arm_net_value": {a: s["net_value_usd"] for a, s in arms.items()}, "policy_observed": policy,
    }
