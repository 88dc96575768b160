"""Column helpers and row filters shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.components import connected_components
from brindle.scratch import drop, materialize, shared_dir

__all__ = ["WORD", "ascii_lower", "connected_components", "drop", "load_tables", "materialize", "read_table", "rows_with_ids", "rows_without_ids", "save_tables", "shared_dir"]

#: A word is a run of anything but space and the control characters tab .. carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


BITS_EACH, MOST_SLOTS = 8, 1 << 26


def rows_with_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id may be among ``ids``: all that are, and a few others.

    A filter of BITS_EACH bits an id, MOST_SLOTS at most (a broadcast table of MOST_SLOTS / 64 rows),
    that spares the text of the other rows the shuffle of the exact join that must follow. Ids too
    many for it to spare any are not sifted: all rows come then.
    """
    found = _sifted(docs, ids, id_col)
    return docs if found is None else found.where("`__in`").drop("__in")


def rows_without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that :func:`rows_with_ids` leaves out."""
    found = _sifted(docs, ids, id_col)
    return docs.limit(0) if found is None else found.where("not `__in`").drop("__in")


def _sifted(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame | None:
    n = ids.count()  # of a written table: from its footers
    if n > 4 * MOST_SLOTS:
        return None
    slots = next((s for s in (1 << 18, 1 << 22, 1 << 24) if s >= BITS_EACH * n), MOST_SLOTS)
    slot = F.pmod(F.xxhash64(id_col), F.lit(slots))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    bits = ids.select(F.floor(slot / 64).alias("__place"), bit.alias("__bit")).groupBy("__place").agg(F.bit_or("__bit").alias("__bits"))
    found = docs.withColumn("__place", F.floor(slot / 64)).join(F.broadcast(bits), "__place", "left")
    return found.withColumn("__in", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__place", "__bits")


def save_tables(tables: dict[str, DataFrame], folder: str) -> str:
    """Write the tables as the next version of ``folder`` (any store that Spark writes to); the version's path.

    The marker ``_WHOLE`` is written last, so a broken save leaves the version before it in force.
    """
    spark = next(iter(tables.values())).sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = f"{folder.rstrip('/')}/v{(_versions(spark, folder) or [-1])[-1] + 1:08d}"
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_WHOLE")
    mark.getFileSystem(conf).create(mark).close()
    return path


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the last whole version of ``folder``; none where there is no such version."""
    found = _versions(spark, folder)
    if not found:
        return {}
    path = f"{folder.rstrip('/')}/v{found[-1]:08d}"
    return {name: spark.read.parquet(f"{path}/{name}") for name in _names(spark, path) if not name.startswith("_")}


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def _versions(spark: SparkSession, folder: str) -> list[int]:
    names = [x for x in _names(spark, folder) if x[:1] == "v" and x[1:].isdigit()]
    return [int(x[1:]) for x in names if "_WHOLE" in _names(spark, f"{folder.rstrip('/')}/{x}")]
