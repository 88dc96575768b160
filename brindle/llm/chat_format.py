"""Operator 2: chat formatting by prefix-target expansion.

A conversation becomes one formatted string, turn after turn. Every assistant turn is an example of
its own: its text is the prefix of that string up to and including the turn, and only that reply is
under the loss mask. Control strings inside texts are escaped so that no text can end its turn:
``\\`` is written ``\\s``, and the first character of a control string ``\\l`` (for ``<``) or ``\\k`` (for
``[``). In escaped text every backslash starts one of these, so the way back is exact.

Built-in functions only. The examples of a conversation share its formatted string; an example's
text is cut from it when a caller reads that column, so long conversations cost their length until
then. One conversation is one string and has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import read_table

OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Markers of this template and of common others; none is left whole inside a text.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(("\\l" if c[0] == "<" else "\\k") + c[1:]))
    return out


def unescape(text: Column) -> Column:
    for code, char in (("\\l", "<"), ("\\k", "["), ("\\s", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, targets): one row per conversation.

    ``turns`` has conv_id, turn, role, text. Rows are taken by turn (nulls first), then role, then
    text, so repeated and tied rows keep a fixed order and all count; null text or role is written
    empty; rows without conv_id form one conversation. ``targets`` holds, for each assistant turn,
    (turn index from 0, start, length) of the escaped reply in ``formatted`` (code points, start
    from 0). Other columns are ignored. No rows: no rows.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY))).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(CLOSE))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    rows = rows.withColumn("at", F.row_number().over(order) - 1).withColumn("start", before + F.length("head"))
    piece = F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "role", "start", F.length("body").alias("length"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("ts"))
    targets = F.transform(F.filter("ts", lambda t: t.role == "assistant"), lambda t: F.struct(t["at"].alias("turn"), t.start.alias("start"), t.length.alias("length")))
    return convs.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.concat_ws("", F.transform("ts", lambda t: t.piece)).alias("formatted"), targets.alias("targets"))


def prefix_target_examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, target_turn, text, loss_start, loss_length.

    ``text`` is the conversation up to the end of the reply; the loss mask is the one span
    [loss_start, loss_start + loss_length). A conversation without a reply gives no example.
    """
    rows = formatted.select("conv_id", "formatted", F.explode("targets").alias("t"))
    return rows.select(
        "conv_id", F.col("t.turn").alias("target_turn"), F.substr("formatted", F.lit(1), F.col("t.start") + F.col("t.length") + len(CLOSE)).alias("text"),
        F.col("t.start").alias("loss_start"), F.col("t.length").alias("loss_length"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>."""
    parts = F.split(formatted, r"<\|end\|>", -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), BODY, 1)).alias("role"), unescape(F.substring_index(p, BODY, -1)).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted strings and their examples say when read back."""
    said = formatted.select("conv_id", parse(F.col("formatted")).alias("ts"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = said.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.sha2(F.concat_ws("", F.transform("ts", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))), 256).alias("turns_sha256"), "formatted_chars")
    examples = prefix_target_examples(formatted)
    loss = examples.select("conv_id", F.struct("target_turn", unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_length"))).alias("text")).alias("t"))
    loss = loss.groupBy("conv_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list("t")), lambda t: t.text)).alias("loss"))
    out = said.alias("s").join(loss.alias("l"), F.col("s.conv_id").eqNullSafe(F.col("l.conv_id")), "left")
    loss_text = F.coalesce("l.loss", F.lit(""))
    return out.select("s.conv_id", "n_turns", "turns_sha256", F.length(loss_text).cast("long").alias("loss_chars"), F.sha2(loss_text, 256).alias("loss_sha256"), "formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digest(format_conversations(turns.unionByName(extra)))


def _sql_escape(text: str) -> str:
    out = f"replace({text}, '\\', '\\s')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{('\\l' if c[0] == '<' else '\\k') + c[1:]}')"
    return out


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum(length({_sql_escape('role')}) + length({_sql_escape('text')}) + {len(OPEN + BODY + CLOSE)}) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
