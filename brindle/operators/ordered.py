"""Places, running totals and quantiles of a total order, with no task that holds all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.scratch import materialize


def running_totals(df: DataFrame, *order: str, **totals: Column) -> DataFrame:
    """``df`` with, for each name, the sum of the column over the row and all rows before it.

    A range-partitioned sort is written, its partitions summed, and windows run inside partitions.
    The table of sums has a row a partition.
    """
    kept = materialize(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()), "ordered")
    kept = kept.withColumn("__part", F.shiftright("__place", 33))
    sums = kept.groupBy("__part").agg(*(F.sum(c).alias(f"__{k}") for k, c in totals.items()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", *(F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in totals))
    inside = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    out = kept.join(F.broadcast(sums), "__part")
    return out.withColumns({k: F.col(f"__{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in totals.items()}).drop("__part", "__place", *(f"__{k}" for k in totals))


def with_global_index(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """``df`` with its rows' places (from 1) in the total order."""
    kept = materialize(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__place", 33)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = kept.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return out.withColumn(name, F.col("__base") + own).drop("__part", "__base", "__place")


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> dict[str, float | None]:
    """Exact interpolated quantiles {name: (column, share)} of the non-null values, None without any.

    All columns are sorted together, and only the two neighbours of each quantile come to the driver.
    """
    columns = sorted({c for c, _ in wanted.values()})
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)))).alias("c")
    cells = df.select(cells).select("c.k", "c.v").where("v is not null")
    placed = materialize(with_global_index(cells, "k", "v", name="at"), "values")
    ends = {r["k"]: (r["first"], r["n"]) for r in placed.groupBy("k").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect()}  # a row a column
    spots: dict[str, tuple[int, float]] = {}
    for name, (column, share) in wanted.items():
        if (end := ends.get(columns.index(column))) is not None:
            spot = share * (end[1] - 1)
            spots[name] = (end[0] + math.floor(spot), spot - math.floor(spot))
    places = sorted({p for p, _ in spots.values()} | {p + 1 for p, part in spots.values() if part})
    value = {r["at"]: r["v"] for r in placed.where(F.col("at").isin(places)).collect()} if places else {}
    out: dict[str, float | None] = dict.fromkeys(wanted)
    for name, (place, part) in spots.items():
        out[name] = value[place] + (value[place + 1] - value[place]) * part if part else value[place]
    return out
