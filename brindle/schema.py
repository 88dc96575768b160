"""The interactions table: schema, canonical form and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERACTIONS = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("item_id", T.LongType()),
    T.StructField("rating", T.DoubleType()), T.StructField("ts", T.TimestampNTZType()),
])
RAW_RATINGS = T.StructType([
    T.StructField("userId", T.LongType()), T.StructField("movieId", T.LongType()),
    T.StructField("rating", T.DoubleType()), T.StructField("timestamp", T.LongType()),
])
#: Names under which a churn probability may come, first match wins (fixed values).
CHURN_COLUMNS = ("p_churn", "churn_prob", "prob_churn", "p", "probability", "score")


def canonicalize(df: DataFrame) -> DataFrame:
    """The four core columns in their types; a ``timestamp`` column stands in for ``ts``.

    Numbers as times are epoch seconds in UTC. Under ANSI mode a value that cannot be cast raises.
    """
    name = "ts" if "ts" in df.columns else "timestamp"
    missing = [c for c in ("user_id", "item_id", "rating", name) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    when = F.col(name)
    if isinstance(df.schema[name].dataType, T.NumericType):
        when = F.timestamp_seconds(when)
    return df.select(F.col("user_id").cast("long"), F.col("item_id").cast("long"), F.col("rating").cast("double"), when.cast("timestamp_ntz").alias("ts"))


def first_present(columns: list[str], candidates: tuple[str, ...]) -> str:
    for c in candidates:
        if c in columns:
            return c
    raise ValueError(f"none of {candidates} among {columns}")


def check_schema(df: DataFrame) -> None:
    """Raise if a core column is missing or of a wrong kind."""
    kinds = {"user_id": T.IntegralType, "item_id": T.IntegralType, "rating": T.NumericType, "ts": (T.TimestampType, T.TimestampNTZType)}
    for name, kind in kinds.items():
        if name not in df.columns:
            raise ValueError(f"missing column: {name}")
        if not isinstance(df.schema[name].dataType, kind):
            raise ValueError(f"{name} is {df.schema[name].dataType.simpleString()}")


def validation_counts(df: DataFrame) -> DataFrame:
    """One row, one pass: n_rows, nulls by column, negative ratings."""
    bad = lambda c: F.count_if(c).alias
    return df.agg(
        F.count("*").alias("n_rows"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("user_id", "item_id", "rating", "ts")), bad(F.col("rating") < 0)("negative_ratings")
    )


def validate_interactions(df: DataFrame) -> None:
    """Schema, no nulls, no negative ratings; raises ``ValueError`` otherwise."""
    check_schema(df)
    found = {k: v for k, v in validation_counts(df).first().asDict().items() if k != "n_rows" and v}
    if found:
        raise ValueError(f"invalid interactions: {found}")
