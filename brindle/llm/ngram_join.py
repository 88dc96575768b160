"""Operator 1: similarity self-join of documents on word n-gram sets (Jaccard).

Plan
 1. One scan gives each row its set's size and fingerprint, and a fixed-size table of hashed
    document frequencies (``2**sketch_bits`` counters over all rows, whatever their number; the
    tables of the tasks are summed in two levels).
 2. Rows with equal sets form a class; only one representative of a class goes on, so copies are
    never paired with each other.
 3. A second scan orders each set rarest first (frequency, then hash) and keeps the prefix that
    any partner at the threshold must meet: ``n - ceil(t*n) + 1`` n-grams, with positions, and
    four words of parities for the suffix filter.
 4. Prefix n-grams that two classes share are the index. Those of at most ``LIGHT`` classes give all
    their pairs that pass the length and positional filters; of heavier ones each class is paired
    with two leaders. The pairs (a linear number) pass the suffix filter and are verified, first
    one partner of each class, then those whose classes are still in different components: links
    inside a component need no proof.
    Then every pair of classes of different components that shares a heavy prefix n-gram and passes
    all filters is verified. Long posting lists are cut by size, as sets of sizes too far apart
    cannot link, and then into blocks that meet pairwise, so no task holds one whole.
    Pairs are verified hub by hub: the text of the class with more pairs goes once to every
    ``PARTNERS`` of its partners, so a hub spreads over tasks.
 5. Components of all links, by large-star / small-star.
 6. For the number of links, every pair of classes of one component whose sizes fit is verified. A
    component is cut by size and into blocks that meet pairwise, each text going once to every block
    that it meets, and the overlaps of two blocks come from one product of their incidence matrices.
    Classes of different components have no link, as step 4 has shown.

Filters for sizes x <= y and needed overlap ``o = ceil(t/(1+t)*(x+y))``: length ``x >= t*y``;
positional ``1 + min(x-i-1, y-j-1) >= o`` at the first shared n-gram (places i, j); suffix: the
hash space is cut into 256 fixed ranges, and a range whose two counts differ in parity holds at
least one n-gram of the symmetric difference, which may have at most ``x + y - 2*o``.

Sets are told apart by 128 bits. Shingles are told apart by 64 bits: two sets of n share one by
chance with probability n**2/2**64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import textkernel as tk
from brindle.llm.common import connected_components, materialize, read_table, rows_with_ids

CHUNKS = 64  # the frequency table travels in so many pieces
LIGHT = 32  # classes that share an n-gram and all meet
BLOCK_ROWS = 1024  # rows of one n-gram that meet in one task
LINK_BLOCK, LINK_NGRAMS = 256, 1 << 18  # classes of one component, and their n-grams, that meet as many others in one task
PARTNERS = 256  # pairs of one class that are verified in one task
PIECES = 256  # tables of tasks that are summed in one task
COLUMNS = 4096  # n-grams of a block that are counted at once


def _fingerprints(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two int64 of each set: sums of two unlike hashes of its members."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(tk.mix(sets ^ np.uint64(salt)), out=total[1:])
        out.append(tk.mix((total[at[1:]] - total[at[:-1]]) ^ (np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64))
    return out[0], out[1]


SETS = "doc_id long, n long, p long, g long, chunk int, salt int, counts binary"


def _scan_sets(k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            sizes, prints = [], []
            for _, data, offsets in tk.slices(batch.column("text")):
                sets, at = tk.shingle_sets(tk.lower(data), offsets, k)
                sizes.append(np.diff(at))
                prints.append(_fingerprints(sets, at))
                np.add.at(table, (sets >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
            n = batch.num_rows
            if n:
                p, g = (pa.array(np.concatenate(x)) for x in zip(*prints, strict=True))
                none = pa.nulls(n, pa.int32())
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "n": pa.array(np.concatenate(sizes)), "p": p, "g": g, "chunk": none, "salt": none, "counts": pa.nulls(n, pa.binary())})
        if table.any():
            none = pa.nulls(CHUNKS, pa.int64())
            salt = TaskContext.get().partitionId() // PIECES
            yield pa.record_batch({"doc_id": none, "n": none, "p": none, "g": none, "chunk": pa.array(range(CHUNKS), pa.int32()), "salt": pa.array([salt] * CHUNKS, pa.int32()), "counts": pa.array([_pressed(x) for x in np.split(table, CHUNKS)], pa.binary())})

    return run


def _pressed(counts: np.ndarray) -> bytes:
    kind = next(t for t in (np.uint8, np.uint16, np.uint32) if counts.max(initial=0) <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + zstandard.compress(counts.astype(kind).tobytes(), 1)


def _counts(pressed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(pressed[1:]), f"<u{pressed[0]}").astype(np.uint64)


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbouring rows of equal (chunk, salt), of rows sorted so; only the sum is held."""
    key, total = None, None

    def done() -> pa.RecordBatch:
        return pa.record_batch({"chunk": pa.array([key[0]], pa.int32()), "salt": pa.array([key[1]], pa.int32()), "counts": pa.array([_pressed(np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32))], pa.binary())})

    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("chunk", "salt", "counts")), strict=True):
            chunk, salt, counts = (x.as_py() for x in row)
            if (chunk, salt) != key:
                if key:
                    yield done()
                key, total = (chunk, salt), 0
            total = total + _counts(counts)
    if key:
        yield done()


def _summed(pieces: DataFrame) -> DataFrame:
    """(chunk, counts) of ``pieces`` (chunk, salt, counts): first PIECES tasks together, then those sums."""
    for last in (False, True):
        pieces = pieces.withColumn("salt", F.lit(0)) if last else pieces
        pieces = pieces.repartition("chunk", "salt").sortWithinPartitions("chunk", "salt").mapInArrow(_sum_chunks, "chunk int, salt int, counts binary")
    return pieces.select("chunk", "counts")


def _scan_prefixes(k: int, bits: int, num: int, den: int, frequencies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequencies.value
        for batch in batches:
            ids = batch.column("doc_id")
            for row, data, offsets in tk.slices(batch.column("text")):
                sets, at = tk.shingle_sets(tk.lower(data), offsets, k)
                n = np.diff(at)
                keep = n - (num * n + den - 1) // den + 1
                keep[n == 0] = 0
                count = often[(sets >> np.uint64(64 - bits)).astype(np.int64)]
                tokens = [sets[a + np.argsort(count[a:b], kind="stable")[:p]] for a, b, p in zip(at[:-1].tolist(), at[1:].tolist(), keep.tolist(), strict=True)]
                word, bit = (sets >> np.uint64(6)) & np.uint64(3), np.uint64(1) << (sets & np.uint64(63))
                some = n > 0
                marks = []
                for w in range(4):
                    mark = np.zeros(len(n), np.uint64)
                    if some.any():
                        mark[some] = np.bitwise_xor.reduceat(np.where(word == np.uint64(w), bit, np.uint64(0)), at[:-1][some])
                    marks.append(pa.array(mark.view(np.int64)))
                p, g = (pa.array(x) for x in _fingerprints(sets, at))
                yield pa.record_batch({
                    "doc_id": ids.slice(row, len(n)), "p": p, "g": g, "n": pa.array(n),
                    "tokens": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)), pa.array(np.concatenate(tokens).view(np.int64))),
                    **{f"s{w}": m for w, m in enumerate(marks)},
                })

    return run


def _sets_of(column: pa.Array, k: int) -> list[np.ndarray]:
    out = []
    for _, data, offsets in tk.slices(column):
        sets, at = tk.shingle_sets(tk.lower(data), offsets, k)
        out += [sets[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


def _verify(k: int, num: int, den: int):
    """Of a hub and some of its partners: the pairs (a, b) that link."""

    def run(t: pa.Table) -> pa.Table:
        hub, h = t.column("hub")[0].as_py(), t.column("h").to_numpy()
        own, good = None, []
        mine = int(np.flatnonzero(h == hub)[0])
        own = _sets_of(t.column("text").slice(mine, 1), k)[0]
        for i in range(0, len(h), 64):
            for x, y in zip(h[i : i + 64].tolist(), _sets_of(t.column("text").slice(i, 64), k), strict=True):
                both = len(own) + len(y) - len(np.union1d(own, y))
                if x != hub and den * both >= num * (len(own) + len(y) - both):
                    good.append(x)
        far = np.array(good, np.int64)
        return pa.table({"a": pa.array(np.minimum(far, hub)), "b": pa.array(np.maximum(far, hub))})

    return run


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``a`` with those at ``b``."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    row, column = row[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total, width = np.zeros((len(a), len(b)), np.int64), int(column[-1]) + 1 if len(column) else 0
    for low in range(0, width, COLUMNS):
        i, j = np.searchsorted(column, [low, low + COLUMNS])
        there = np.zeros((len(sets), min(COLUMNS, width - low)), np.float32)
        there[row[i:j], column[i:j] - low] = 1
        total += (there[a] @ there[b].T).astype(np.int64)
    return total


def _degrees(k: int, num: int, den: int):
    """Of two blocks of a component (or one, with itself): each class and the rows that its links in there lead to."""

    def run(t: pa.Table) -> pa.Table:
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        h, copies, mine = (t.column(c).to_numpy() for c in ("h", "copies", "mine"))
        sets = [x for chunk in t.column("text").chunks for x in _sets_of(chunk, k)]
        a, b = (np.flatnonzero(mine == x) for x in (lo, hi))
        n, both = np.array([len(x) for x in sets]), _overlaps(sets, a, b)
        link = den * both >= num * (n[a][:, None] + n[b] - both)
        degree = np.zeros(len(h), np.int64)
        if lo == hi:
            np.fill_diagonal(link, False)
            degree[a] = link @ copies[b]
        else:
            degree[a], degree[b] = link @ copies[b], copies[a] @ link
        return pa.table({"h": pa.array(h), "links": pa.array(degree)})

    return run


def _needed(x: Column, y: Column, num: int, den: int) -> Column:
    """Least overlap of sets of sizes x and y at the threshold num/den."""
    return F.ceil(((x + y) * num).cast("long") / F.lit(num + den)).cast("long")


def _sizes_fit(l: str, r: str, num: int, den: int) -> Column:
    """Length filter, and the positional one where the rows have ``pos``."""
    x, y = F.col(f"{l}.n"), F.col(f"{r}.n")
    return (F.least(x, y) * den >= F.greatest(x, y) * num) & (F.least(x - F.col(f"{l}.pos"), y - F.col(f"{r}.pos")) >= _needed(x, y, num, den))


def _suffixes_fit(l: str, r: str, num: int, den: int) -> Column:
    x, y = F.col(f"{l}.n"), F.col(f"{r}.n")
    apart = sum((F.bit_count(F.col(f"{l}.s{w}").bitwiseXOR(F.col(f"{r}.s{w}"))) for w in range(4)), F.lit(0))
    return apart <= x + y - _needed(x, y, num, den) * 2


def ngram_jaccard_join(docs: DataFrame, k: int = 5, threshold: Fraction | float | str = "0.8", sketch_bits: int = 22, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links).

    With ``links`` also ``n_links``: the number of other rows, copies included, that the row links with.

    Texts are lower-cased for A-Z; words are runs of anything but space and tab..carriage return.
    Null or word-less text: ``n_shingles`` 0, linked with nothing, its own id as component. Fewer
    than ``k`` words: the whole sequence is the one n-gram. Equal sets always link. Rows that
    repeat an id stay separate rows; a component's id is the smallest non-null id in it, and a row
    with a null id and no links has a null component. Other columns are ignored. No rows: no rows.
    """
    t = Fraction(str(threshold))
    num, den = t.numerator, t.denominator
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    scan = materialize(docs.mapInArrow(_scan_sets(k, sketch_bits), SETS), "sets")
    rows = scan.where("chunk is null").select("doc_id", "n", "p", "g")
    table = np.zeros(1 << sketch_bits, np.uint32)
    width = len(table) // CHUNKS
    for chunk, counts in _summed(scan.where("chunk is not null").select("chunk", "salt", "counts")).toLocalIterator():  # CHUNKS rows
        table[chunk * width : (chunk + 1) * width] = _counts(bytes(counts))
    frequencies = spark.sparkContext.broadcast(table)

    # h numbers the classes of rows with equal sets.
    reps = rows.where("n > 0").groupBy("p", "g").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    reps = materialize(reps.withColumn("h", F.monotonically_increasing_id()), "classes")
    prefixes = docs.where("text is not null").mapInArrow(_scan_prefixes(k, sketch_bits, num, den, frequencies), "doc_id long, p long, g long, n long, tokens array<long>, s0 long, s1 long, s2 long, s3 long")
    same = (F.col("p.p") == F.col("r.p")) & (F.col("p.g") == F.col("r.g")) & F.col("p.doc_id").eqNullSafe(F.col("r.doc_id"))
    prefixes = materialize(prefixes.where("n > 0").alias("p").join(reps.hint("merge").alias("r"), same).select("r.h", "p.*").dropDuplicates(["h"]), "prefixes")
    facts = prefixes.select("h", "doc_id", "p", "g", "n", "s0", "s1", "s2", "s3")

    postings = prefixes.select("h", "n", F.posexplode("tokens").alias("pos", "token"))
    often = materialize(postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    shared = materialize(postings.join(often, "token"), "shared")
    light, heavy = shared.where(F.col("df") <= LIGHT), shared.where(F.col("df") > LIGHT)
    ends = F.least("l.h", "r.h").alias("a"), F.greatest("l.h", "r.h").alias("b")
    meet = (F.col("l.token") == F.col("r.token")) & (F.col("l.h") < F.col("r.h"))
    pairs = light.alias("l").join(light.alias("r"), meet & _sizes_fit("l", "r", num, den)).select(*ends)
    leads = heavy.groupBy("token").agg(F.min(F.struct("n", "h")).alias("l1"), F.min(F.struct(F.xxhash64("h").alias("by"), "n", "h")).alias("l2"))
    leads = heavy.join(materialize(leads, "leads"), "token").select("h", "n", F.explode(F.array(F.struct("l1.h", "l1.n"), F.struct("l2.h", "l2.n"))).alias("r")).alias("l")
    fit = (F.col("l.h") != F.col("r.h")) & (F.least("n", "r.n") * den >= F.greatest("n", "r.n") * num)
    pairs = pairs.unionByName(leads.where(fit).select(*ends)).distinct()
    pairs = pairs.join(facts.alias("x"), F.col("a") == F.col("x.h")).join(facts.alias("y"), F.col("b") == F.col("y.h")).where(_suffixes_fit("x", "y", num, den))
    pairs = materialize(pairs.select("a", "b"), "pairs")

    each = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = each.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("by"), "b")).alias("best")).select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()
    linked = _verified(docs, facts, materialize(first, "first"), k, num, den)
    part = connected_components(linked, "a", "b")
    named = facts.join(part, F.col("h") == F.col("node"), "left").select("h", "n", "s0", "s1", "s2", "s3", F.coalesce("component", "h").alias("part"))
    side = lambda c: named.select(F.col("h").alias(c), F.col("part").alias(f"part_{c}"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(side("a"), "a").join(side("b"), "b").where("part_a <> part_b").select("a", "b")
    linked = linked.unionByName(_verified(docs, facts, materialize(rest, "rest"), k, num, den))
    part = materialize(connected_components(linked, "a", "b"), "parts")

    if not heavy.isEmpty():
        named = facts.join(part, F.col("h") == F.col("node"), "left").select("h", "s0", "s1", "s2", "s3", F.coalesce("component", "h").alias("part"))
        listed = heavy.select("token", "h", "n", "pos").join(named.select("h", "part"), "h").withColumn("level", _level(t))
        torn = listed.groupBy("token").agg(F.min("part").alias("p1"), F.max("part").alias("p2")).where("p1 <> p2").select("token")
        torn = materialize(torn, "torn")
        open_ = materialize(listed.join(torn, "token").join(named.drop("part"), "h"), "open")
        sizes = materialize(open_.groupBy("token", "level").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), "posting-blocks")
        left = open_.join(sizes, ["token", "level"]).withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")).alias("l")
        # A set meets those of its own level of size and of the two beside it.
        right = open_.withColumn("level", F.explode(F.array(*(F.col("level") + i for i in (-1, 0, 1))))).join(sizes, ["token", "level"])
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("r")
        meet &= (F.col("l.level") == F.col("r.level")) & (F.col("l.block") == F.col("r.block")) & (F.col("l.part") != F.col("r.part"))
        more = left.join(right, meet & _sizes_fit("l", "r", num, den) & _suffixes_fit("l", "r", num, den)).select(*ends).distinct()
        more = _verified(docs, facts, materialize(more.join(pairs, ["a", "b"], "left_anti"), "more"), k, num, den)
        part = materialize(connected_components(linked.unionByName(more), "a", "b"), "parts")

    classes = reps.join(part, F.col("h") == F.col("node"), "left").select("h", "p", "g", "doc_id", "copies", F.coalesce("component", "h").alias("part"))
    ends = materialize(classes.groupBy("part").agg(F.min("doc_id").alias("component_id")), "ends")
    classes = classes.join(ends, "part").select("h", "p", "g", "component_id", "copies")
    if links:
        own = facts.select("h", "n").join(reps.select("h", "copies"), "h").join(part, F.col("h") == F.col("node")).select("h", "n", "copies", F.col("component").alias("part"))
        classes = classes.join(_link_counts(docs, facts, own, k, t), "h", "left")
        classes = classes.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    classes = materialize(classes.drop("h", "copies", "links"), "components")
    out = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")]
    return rows.join(classes, ["p", "g"], "left").select(*out, *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []))


def _level(t: Fraction) -> Column:
    """Sets whose levels are two or more apart differ in size by more than the threshold t allows."""
    return F.floor(F.log(F.col("n").cast("double")) / -math.log(float(t) * (1 - 1e-9)) if t < 1 else F.col("n")).cast("int")


def _link_counts(docs: DataFrame, facts: DataFrame, own: DataFrame, k: int, t: Fraction) -> DataFrame:
    """(h, links) of the classes ``own`` (h, n, copies, part) of components of two or more: rows of other classes that they link with."""
    own = materialize(own.withColumn("level", _level(t)), "members")
    most = F.greatest(F.count("*") / LINK_BLOCK, F.sum("n") / LINK_NGRAMS)
    sizes = materialize(own.groupBy("part", "level").agg(F.ceil(most).cast("int").alias("blocks")), "part-blocks")
    # A block is (level, number) in one long; levels two or more apart do not meet.
    block = lambda level, i: level.cast("long") * (1 << 32) + i
    mine = own.join(sizes, ["part", "level"]).withColumn("mine", block(F.col("level"), F.pmod(F.xxhash64("h"), F.col("blocks")))).drop("blocks")
    cells = mine.alias("m").join(sizes.alias("s"), (F.col("m.part") == F.col("s.part")) & (F.abs(F.col("m.level") - F.col("s.level")) <= 1))
    cells = cells.select("m.part", "m.mine", "m.h", "m.copies", F.col("s.level").alias("far"), F.explode(F.sequence(F.lit(0), F.col("s.blocks") - 1)).alias("i"))
    cells = cells.withColumn("other", block(F.col("far"), F.col("i")))
    cells = cells.select("part", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "h", "copies")
    cells = cells.join(_texts(docs, facts, own.select("h"), k), "h")
    found = materialize(cells.groupBy("part", "lo", "hi").applyInArrow(_degrees(k, t.numerator, t.denominator), "h long, links long"), "degrees")
    return found.groupBy("h").agg(F.sum("links").alias("links"))


def _texts(docs: DataFrame, facts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(h, text), one text of each wanted set. Only those texts are shuffled."""
    wanted = materialize(facts.select("h", "doc_id", "p", "g").join(wanted, "h", "left_semi"), "wanted")
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
    texts = rows_with_ids(docs, wanted).alias("t").join(wanted.hint("merge").alias("w"), same).select("w.h", "w.p", "w.g", "text")
    return materialize(texts.mapInArrow(_of_set(k), "h long, text string").dropDuplicates(["h"]), "texts")


def _verified(docs: DataFrame, facts: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose texts link."""
    if pairs.isEmpty():
        return pairs.select("a", "b")
    each = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).groupBy("h").agg(F.count("*").alias("n"))
    each = materialize(each, "degrees")
    both = pairs.join(each.select(F.col("h").alias("a"), F.col("n").alias("n_a")), "a").join(each.select(F.col("h").alias("b"), F.col("n").alias("n_b")), "b")
    hub = F.struct(F.greatest("n_a", "n_b").alias("n"), F.when(F.col("n_a") >= F.col("n_b"), F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(F.col("n_a") >= F.col("n_b"), F.col("b")).otherwise(F.col("a")).alias("h")).alias("s")
    cells = both.select(hub).select("s.hub", "s.h", F.pmod(F.xxhash64("s.h"), F.ceil(F.col("s.n") / PARTNERS)).cast("int").alias("cell"))
    cells = materialize(cells, "hubs")
    cells = cells.unionByName(cells.select("hub", F.col("hub").alias("h"), "cell").distinct())
    texts = _texts(docs, facts, each.select("h"), k)
    return materialize(cells.join(texts, "h").groupBy("hub", "cell").applyInArrow(_verify(k, num, den), "a long, b long"), "links")


def _of_set(k: int):
    """Rows whose text has the set they are wanted for (an id may stand in rows with other texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_fingerprints(*tk.shingle_sets(tk.lower(data), offsets, k)) for _, data, offsets in tk.slices(batch.column("text"))]
            if prints:
                p, g = (np.concatenate(x) for x in zip(*prints, strict=True))
                yield batch.select(["h", "text"]).filter(pa.array((p == batch.column("p").to_numpy()) & (g == batch.column("g").to_numpy())))

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read_table(spark, sf_dir, "documents"), k=3, threshold="0.9", links=True)
