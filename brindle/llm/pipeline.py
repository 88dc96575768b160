"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents that the one before it kept and returns documents with the same
columns; the last returns packed pieces. ``n_chars`` follows the text.

In every stage each row is decided on by itself, so rows may repeat an id, or have none, and may repeat
as a whole. Null, empty and wordless texts: the classifier scores them like any text, line dedup leaves
them, they are nobody's copies, and the mix, which is of words, does not take them. Columns other than
doc_id, text, source and n_chars are carried along whatever their names. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import line_dedup, ngram_join, packing, quality_qda, source_mix
from brindle.llm.common import materialize, read_table, rows_with_ids, rows_without_ids


def _packed(docs: DataFrame) -> DataFrame:
    """Whole rows as one column, so that no name of theirs meets one of ours."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def _without(rows: DataFrame, gone: DataFrame, id_col: str, *also: str) -> DataFrame:
    """The documents of ``rows`` (row, id_col, also) less those in ``gone`` (nulls match); only rows that may be among them are shuffled."""
    same = F.lit(True)
    for c in (id_col, *also):
        same &= F.col(f"d.{c}").eqNullSafe(F.col(f"g.{c}"))
    near = rows_with_ids(rows, gone, id_col).alias("d").join(gone.hint("merge").alias("g"), same, "left_anti").select("row")
    return rows_without_ids(rows, gone, id_col).select("row").unionByName(near).select("row.*")


def _counted(docs: DataFrame) -> DataFrame:
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return docs.withColumn("n_chars", F.length("text").cast(kind)) if kind else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Each row is judged by its own text, also without an id."""
    scored = quality_qda.classify(docs, read_table(spark, sf_dir, "labels"))
    gone = materialize(scored.where("predicted = 0").select("doc_id", "key").distinct(), "rejected")
    rows = _packed(docs).withColumns({"doc_id": F.col("row.doc_id").cast("long"), "key": F.xxhash64(F.col("row.text").cast("string"))})
    return _without(rows, gone, "doc_id", "key")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs, of three lines or over fifty words, are deleted; a document that they made up whole goes."""
    cut = line_dedup.line_dedup(docs, stats=True, long_words=50)
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return _counted(left.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8) stays: of smallest id (nulls last), then text hash, then any."""
    rows = materialize(_packed(docs).withColumn("at", F.monotonically_increasing_id()), "numbered")
    joined = ngram_join.ngram_jaccard_join(rows.select("at", "row.text"), k=5, threshold="0.8", id_col="at").withColumnRenamed("doc_id", "at")
    place = F.struct(F.col("row.doc_id").isNull().alias("last"), F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("print"), "at").alias("place")
    placed = joined.join(rows.select("at", place), "at")
    first = materialize(placed.groupBy("component_id").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1"), "first-copies")
    gone = placed.join(first, "component_id").where("at <> first.at").select("at")
    return _without(rows, materialize(gone, "copies"), "at")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights: documents come as often, and as far, as the mix takes them."""
    return _counted(source_mix.mixed_documents(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("source mix", mix), ("best-fit packing", sequences)]

#: Seeded draws, connected components and a tokenizer: SQL cannot express these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
