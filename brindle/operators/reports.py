"""Summary tables, the data behind figures, and small text reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.ordered import quantiles


def monthly_split_counts(labeled: DataFrame) -> DataFrame:
    return labeled.groupBy(F.date_trunc("month", "ts").cast("date").alias("month"), "split").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, lo, hi, n) of equal-width bins from least to greatest; the last bin is closed, empty bins are left out."""
    ends = df.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b"))
    width = (F.col("b") - F.col("a")) / F.lit(float(bins))
    v = F.col(column).cast("double")
    at = F.when(F.col("b") > F.col("a"), F.least(F.lit(bins - 1).cast("long"), F.floor((v - F.col("a")) / F.nullif(width, F.lit(0.0))))).otherwise(0)
    rows = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    g = rows.groupBy(at.cast("int").alias("bin"), "a", "b").agg(F.count("*").alias("n"))
    return g.select("bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), "n")


def degree_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src_item").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n"))


def cluster_sizes(clusters: DataFrame, top: int = 30) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(top)


def risk_quadrants(risk: DataFrame) -> DataFrame:
    """One row: the medians that cut the quadrants of probability against value, and the 90 % quantile of risk."""
    q = quantiles(risk, {"p_median": ("p_churn", 0.5), "ltv_median": ("ltv_usd", 0.5), "risk_q90": ("revenue_at_risk_usd", 0.9)})
    return risk.sparkSession.createDataFrame([tuple(q.values())], ", ".join(f"{k} double" for k in q))


def cosine_against_cooccurrence(edges: DataFrame, bins: int = 20) -> DataFrame:
    """(cooc_cnt, bin, n): edges by co-occurrence and by cosine in equal bins of [0, 1], the last closed."""
    at = F.least(F.lit(bins - 1).cast("long"), F.floor(F.col("cosine") * bins)).cast("int")
    return edges.groupBy("cooc_cnt", at.alias("bin")).agg(F.count("*").alias("n"))


def arm_bars(stats: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """(variant, n, mean_y, lo, hi) of :func:`experiments.arm_stats`: means with their 95 % intervals."""
    half = F.lit(z) * F.sqrt(F.col("var_y") / F.col("n"))
    return stats.select("variant", "n", "mean_y", (F.col("mean_y") - half).alias("lo"), (F.col("mean_y") + half).alias("hi"))


def plot_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The same ``n`` rows every time, by the hash of their key."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


def summary_table(parts: dict[str, DataFrame]) -> DataFrame:
    """(phase, metric, value): every numeric column of one-row tables, by phase; missing phases are simply not given."""
    long = []
    for phase, row in parts.items():
        names = [c for c, t in row.dtypes if t not in ("string", "date", "timestamp", "timestamp_ntz", "boolean")]
        cells = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names)))
        long.append(row.select(F.lit(phase).alias("phase"), cells.alias("c")).select("phase", "c.metric", "c.value"))
    return reduce(lambda a, b: a.unionByName(b), long)


def intervention_markdown(summary: dict) -> str:
    rows = "\n".join(f"| {k} | {v:,.2f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in summary.items())
    return f"# Interventions\n\n| figure | value |\n| --- | --- |\n{rows}\n"


def experiment_markdown(report: dict) -> str:
    d = report["design"]
    tests = "\n".join(f"| {a} | {t['effect']:.4f} | {t['z']:.3f} | {t['p_value']:.4f} |" for a, t in sorted(report["tests_vs_control"].items()))
    return f"# Experiment {report['experiment_id']}\n\nalpha {d['alpha']}, power {d['power']}, smallest change {d['mde']}; {d['n_per_arm']} users an arm.\n\n| arm | effect | z | p |\n| --- | --- | --- | --- |\n{tests}\n"
