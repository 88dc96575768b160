"""Operator 3: mixing sources to target weights.

The words of a source, documents in a pseudorandom order, form one stream that is packed into
blocks of ``block`` words (fewer where a source has few). An output shard has ``slots`` slots; how many
of them each source fills is a multinomial draw under the condition that all shards together give each
source its quota. Such draws need no state: going down a binary tree over the shards, each node deals
its counts out to its halves (a multivariate hypergeometric draw, seeded by the node), so a task draws
the shards of its own range, and knows how many slots of each source stand before them. Slot i of a
source, counted over all shards, takes the block that the pseudorandom permutation of its source and
epoch puts at place i: one epoch uses each block once. Blocks are then joined by (source, index).

Every source ends within a block of its target and no block is used more than ``most`` times. All draws
follow from seeds, so reruns agree.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating; they share the words of all,
and no target is above ``most`` times its source's words, the excess shared again by weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import WORD, materialize, read_table

RANKED = 1 << 10  # documents of one source, about, whose words are summed in one task
FINE = 256  # blocks that a source is cut into at least, if it has the words
SHARDS = 64  # shards that one task draws and fills
LARGEST = 10**9  # slots of a tree node that are still dealt out at random; larger nodes halve in proportion


def targets(sizes: dict[str | None, int], most: int = 3) -> dict[str | None, float]:
    """Words that each source should give.

    Sources are filled to their bound in the order in which a rising level by weight meets the bounds.
    """
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, left, total = {s: 0.0 for s in names}, sum(sizes.values()), sum(weight[s] for s in names if sizes[s])
    order = sorted((s for s in names if sizes[s]), key=lambda s: sizes[s] / weight[s])
    for i, s in enumerate(order):
        if left * weight[s] <= most * sizes[s] * total:  # and so for all after it
            out |= {r: left * weight[r] / total for r in order[i:]}
            break
        out[s] = float(most * sizes[s])
        left, total = left - most * sizes[s], total - weight[s]
    return out


def feistel(i: np.ndarray, n: int, seed: list[int]) -> np.ndarray:
    """Places i under a pseudorandom permutation of 0..n-1, each found on its own.

    A four-round Feistel network over the smallest power of four that holds n, walked on until the
    value is below n (at most four steps on average), so a task needs no table of the permutation.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(0, 1 << 63, 4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & low
        for k in keys:
            f = (b ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(31)) & low)
        return a << np.uint64(half) | b

    out = once(i.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _halved(counts: np.ndarray, n: int, seed: list[int]) -> np.ndarray:
    """How many of ``counts`` are among n drawn without putting back."""
    total = int(counts.sum())
    if total < LARGEST:
        return np.random.default_rng(seed).multivariate_hypergeometric(counts, n, method="marginals")
    exact = [int(c) * n for c in counts.tolist()]
    out = np.array([x // total for x in exact], np.int64)
    rest = np.array([x % total for x in exact], float)
    out[np.argsort(-rest, kind="stable")[: n - int(out.sum())]] += 1
    return out


def shard_counts(quota: np.ndarray, slots: int, low: int, high: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, sources, their slots in it, their slots in all shards before) of the shards low .. high - 1."""
    total = int(quota.sum())

    def deal(a: int, b: int, source: np.ndarray, counts: np.ndarray, before: np.ndarray) -> Iterator[tuple]:
        some = counts > 0
        source, counts, before = source[some], counts[some], before[some]
        if b - a == 1:
            yield a, source, counts, before
            return
        mid = (a + b) // 2
        left = _halved(counts, min(total, mid * slots) - a * slots, [seed, a, b])
        if low < mid:
            yield from deal(a, mid, source, left, before)
        if high > mid:
            yield from deal(mid, b, source, counts - left, before + left)

    shards = -(-total // slots)
    if low < high:
        for found in deal(0, shards, np.arange(len(quota)), quota, np.zeros(len(quota), np.int64)):
            if low <= found[0] < high:
                yield found


def _fill(plan, slots: int, seed: int):
    """Block and epoch of every slot of the shards of a range (low, high)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quota, blocks = plan.value
        for frame in frames:
            for low, high in zip(frame["low"], frame["high"], strict=True):
                for shard, source, n, before in shard_counts(quota, slots, int(low), int(high), seed):
                    parts = []
                    for s, m, first in zip(source.tolist(), n.tolist(), before.tolist(), strict=True):
                        i = np.arange(first, first + m, dtype=np.int64)
                        epoch, place = i // blocks[s], i % blocks[s]
                        block = np.empty(m, np.int64)
                        for e in np.unique(epoch):
                            at = epoch == e
                            block[at] = feistel(place[at], int(blocks[s]), [seed, s, int(e)])
                        parts.append(pd.DataFrame({"shard": shard, "rank": s, "epoch": epoch, "block": block}))
                    yield pd.concat(parts)

    return run


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan_mix(sized: DataFrame, block: int = 128, slots: int = 4096, most: int = 3, seed: int = 20240501) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, sources) of the mix of ``sized``: any columns with source, size and key.

    ``key`` (long) orders a source's documents and should be a hash of what tells rows apart; equal
    rows may tie, which changes nothing. documents: the input with rank, length (of its source's
    blocks) and offset, its first word in its source's stream. slots: (shard, rank, epoch, block), one
    row per slot. sources: (rank, source, source_size, blocks, length, target). The driver plans the
    sources and broadcasts two numbers of each; their number, not that of documents, bounds it.
    """
    spark = sized.sparkSession
    counted = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()  # a row a source
    sizes = {r["source"]: r["words"] for r in counted}
    want = targets(sizes, most)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    length = {s: max(1, min(block, sizes[s] // FINE)) for s in names}
    blocks = [-(-sizes[s] // length[s]) for s in names]
    # A source gives its mean block, whose last may be short.
    quota = [min(round(want[s] * b / sizes[s]), most * b) if b else 0 for s, b in zip(names, blocks, strict=True)]
    parts = {r["source"]: -(-r["docs"] // RANKED) for r in counted}
    schema = "rank int, source string, source_size long, blocks long, length long, target double, parts long"
    planned = spark.createDataFrame([(i, s, sizes[s], blocks[i], length[s], want[s], parts[s]) for i, s in enumerate(names)], schema)
    sources = planned.drop("parts")

    ranked = sized.alias("d").join(F.broadcast(planned).alias("r"), F.col("d.source").eqNullSafe(F.col("r.source"))).select("d.*", "r.rank", "r.length", F.pmod("d.key", "r.parts").alias("part"))
    before = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranked.groupBy("rank", "part").agg(F.sum("size").alias("words"))  # a row for RANKED documents, or a source
    bases = materialize(bases.select("rank", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")), "bases")
    inner = Window.partitionBy("rank", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = ranked.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(bases, ["rank", "part"])
    docs = docs.select(*(F.col(f"`{c}`") for c in sized.columns), "rank", "length", (F.col("base") + F.col("inner")).alias("offset"))

    shards = -(-sum(quota) // slots)
    if not shards:
        return docs, spark.createDataFrame([], "shard long, rank int, epoch long, block long"), sources
    plan = spark.sparkContext.broadcast((np.array(quota, np.int64), np.array(blocks, np.int64)))
    tasks = -(-shards // SHARDS)
    ranges = spark.range(0, tasks, 1, tasks).select((F.col("id") * SHARDS).alias("low"), F.least((F.col("id") + 1) * SHARDS, F.lit(shards)).alias("high"))
    filled = ranges.mapInPandas(_fill(plan, slots, seed), "shard long, rank int, epoch long, block long")
    return docs, materialize(filled, "slots"), sources


def pieces(docs: DataFrame, slots: DataFrame) -> DataFrame:
    """Documents' pieces with the times their block is taken: the columns of ``docs``, start, words, times."""
    times = slots.groupBy("rank", "block").agg(F.count("*").alias("times"))
    cut = docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / F.col("length")), F.floor((F.col("offset") + F.col("size") - 1) / F.col("length")))))
    start = F.greatest(F.lit(0), F.col("block") * F.col("length") - F.col("offset"))
    end = F.least(F.col("size"), (F.col("block") + 1) * F.col("length") - F.col("offset"))
    cut = cut.withColumn("start", start).withColumn("words", end - F.col("start"))
    return cut.join(times, ["rank", "block"]).drop("block")


def source_mix(docs: DataFrame, block: int = 128, slots: int = 4096, most: int = 3, seed: int = 20240501) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken (words, repeats counted).

    Null text: size 0. A null source is a source of its own. Rows that repeat an id are documents
    of their own. Documents without words, and all documents of a corpus without words, take 0.
    ``taken`` is at most ``most`` times ``size``. Other columns are ignored.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("key"))
    sized = materialize(sized, "sized")
    placed, filled, sources = plan_mix(sized, block, slots, most, seed)
    placed = materialize(placed, "placed")
    taken = pieces(placed, filled).groupBy("rank", "offset", "doc_id", "key").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # Documents with words differ by offset within their source.
    same = (F.col("p.rank") == F.col("t.rank")) & (F.col("p.offset") == F.col("t.offset")) & (F.col("p.size") > 0)
    out = placed.alias("p").join(taken.alias("t"), same, "left").join(F.broadcast(sources).alias("s"), F.col("p.rank") == F.col("s.rank"))
    return out.select("p.doc_id", "p.size", "p.source", "s.source_size", "s.target", F.coalesce("t.taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, block: int = 128, slots: int = 4096, most: int = 3, seed: int = 20240501) -> DataFrame:
    """The mix itself, with the columns of ``docs`` (text and source among them).

    A document comes once for every time that some block of it is taken: copy t holds the words of
    its blocks that are taken t times or more, joined by one space, or the text as it was if they
    are all its blocks. Documents that the mix does not take, and those without words, are not in it.
    """
    names = docs.columns
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    every = [F.col(f"row.`{c}`") for c in names]
    row = row.withColumn("key", F.xxhash64(*every)).withColumn("mark", F.xxhash64(F.lit(1), *every))  # 128 bits tell rows apart
    sized = materialize(row.select(F.col("row.source").cast("string").alias("source"), word_count(F.col("row.text")).alias("size"), "key", "mark"), "sized")
    placed, filled, _ = plan_mix(sized, block, slots, most, seed)
    took = pieces(materialize(placed, "placed"), filled)
    took = took.groupBy("key", "mark", "rank", "offset").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("words").cast("int").alias("words"), "times"))).alias("took"), F.max("times").alias("most"), F.first("size").alias("size"))
    # Rows that are equal in all columns have one key: any of them will do for each.
    rows = row.dropDuplicates(["key", "mark"]).join(took, ["key", "mark"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))))
    rows = rows.withColumn("mine", F.filter("took", lambda p: p.times >= F.col("copy"))).withColumn("n", F.aggregate("mine", F.lit(0), lambda a, p: a + p.words))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("mine", lambda p: F.slice(F.col("all"), p.start + 1, p.words))), " ")
    rows = rows.withColumn("all", F.when(F.col("n") < F.col("size"), words))
    rows = rows.withColumn("text", F.when(F.col("n") < F.col("size"), cut).otherwise(F.col("row.text")))
    return rows.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(read_table(spark, sf_dir, "documents"))
