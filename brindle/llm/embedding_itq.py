"""Operator 6: near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

ITQ (Gong and Lazebnik, 2011) learns one rotation of the centred principal axes whose signs are
balanced binary codes close to the vectors. A code is cut into substrings, and every substring is one
hash table (Norouzi et al., 2012): codes within the Hamming radius share a bucket of some table, where
a vector stands in the bucket of its substring and, with ``probe`` 1, in those one bit away. Pairs of
a bucket are first held by the Hamming distance of their whole codes; only vectors that have a
partner within the radius are fetched, and those pairs are ranked by the cosine of the original
vectors, in double precision.

The rotation is fitted on a bounded sample, on which neighbours at exactly the least cosine are drawn
too: they tell the radius and which cut of the code reaches ``recall`` at the least cost. Every vector
is coded and indexed.

Equal vectors are one node with a multiplicity. A bucket is worked through in blocks of at most
``BLOCK`` rows that meet pairwise, so a hot bucket spreads over tasks; a block gives each node its
number of links (a pair counts in the first table, and there in one bucket, in which it meets) and a
forest of links, so what leaves a block is linear in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import connected_components, materialize, read_table

SAMPLE = 16_384  # vectors that the rotation is fitted on, at most
SAMPLE_VALUES = 1 << 22  # and numbers
BITS = 128
BLOCK = 1024
WIDTHS = 64  # widths with codes of their own; vectors of rarer widths all meet
CELL = ["width", "t", "bucket", "lo", "hi"]


@dataclass(frozen=True)
class Index:
    """Codes are the signs of ``(unit - mean) @ project``, cut into substrings of ``size`` bits."""

    mean: np.ndarray
    project: np.ndarray
    size: int = 8
    probe: int = 0
    radius: int = BITS

    def words(self, unit: np.ndarray) -> np.ndarray:
        """(n, BITS / 64) uint64."""
        signs = (unit - self.mean) @ self.project >= 0
        return np.packbits(signs, axis=1, bitorder="little").view(np.uint64)

    def keys(self, words: np.ndarray) -> np.ndarray:
        """(n, tables) int64, the substrings."""
        each = 64 // self.size
        mask = np.uint64((1 << self.size) - 1)
        return np.stack([(words[:, t // each] >> np.uint64(t % each * self.size)) & mask for t in range(BITS // self.size)], axis=1).astype(np.int64)

    def buckets(self, words: np.ndarray) -> np.ndarray:
        """(n, tables, buckets of a table in which a vector stands) int64."""
        keys = self.keys(words)
        flips = np.array([0, *(1 << i for i in range(self.size))][: 1 + self.size * self.probe], np.int64)
        return keys[:, :, None] ^ flips

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(a[:, None, w] ^ b[None, :, w]).astype(np.int16) for w in range(a.shape[1]))

    def meets(self, a: np.ndarray, b: np.ndarray, table: int, bucket: int) -> np.ndarray:
        """(len(a), len(b)) bool: pairs within the radius whose place to count is this bucket."""
        near = self.distance(a, b) <= self.radius
        if not near.any():
            return near
        ka, kb = self.keys(a), self.keys(b)
        for t in range(table):
            near &= np.bitwise_count(ka[:, None, t] ^ kb[None, :, t]) > 2 * self.probe
        x, y = ka[:, None, table], kb[None, :, table]
        if self.probe:  # two substrings two bits apart meet in two buckets, nearer ones in more
            apart = x ^ y
            low = apart & -apart
            least, most = np.minimum(x, y), np.maximum(x, y)
            place = np.where(apart == low, least, (x & y) | (least & low) | (most & (apart ^ low)))
            return near & (place == bucket)
        return near & (x == bucket) & (y == bucket)


def itq(sample: np.ndarray, bits: int = BITS, seed: int = 20240501, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, (d, bits) projection): centred principal axes, then the rotation that iterative quantisation ends with."""
    d = sample.shape[1]
    mean = sample.mean(0)
    _, _, axes = np.linalg.svd((sample - mean).T @ (sample - mean) / max(len(sample), 1))
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    # Axes beyond the vectors' width: random directions stand in.
    axes = axes.T[:, :bits] if bits <= d else np.column_stack([axes.T, rng.standard_normal((d, bits - d)) / math.sqrt(d)])
    low = (sample - mean) @ axes
    for _ in range(rounds):
        code = np.where(low @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(code.T @ low)
        rotation = (u @ v).T
    return mean, axes @ rotation


def fit(sample: np.ndarray, n: int, least: float, recall: float = 0.98, seed: int = 20240501) -> Index:
    """Index for n unit vectors: rotation, radius and cut of the code from the sample."""
    mean, project = itq(sample, BITS, seed)
    rng = np.random.default_rng(seed + 1)
    x = sample[:2048]
    off = rng.standard_normal(x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(off, axis=1, keepdims=True)
    near = least * x + math.sqrt(max(0.0, 1 - least * least)) * off / np.where(size > 0, size, 1)
    whole = Index(mean, project)
    a, b = whole.words(x), whole.words(near)
    distance = np.bitwise_count(a ^ b).sum(1)
    radius = int(np.quantile(distance, 1 - (1 - recall) / 4, method="higher"))
    found = []
    for bits in (8, 16, 32):
        for probe in (0, 1):
            index = Index(mean, project, bits, probe, radius)
            meet = (np.bitwise_count(index.keys(a) ^ index.keys(b)) <= 2 * probe).any(1) & (distance <= radius)
            rows = BITS // bits * (1 + bits * probe) * n
            pairs = BITS // bits * 2.0**bits * (n * (1 + bits * probe) / 2.0**bits) ** 2 / 2
            found.append((float(meet.mean()), rows * 1e-6 + pairs * 5e-9, index))
    enough = [f for f in found if f[0] >= recall] or [max(found, key=lambda f: f[0])]
    return min(enough, key=lambda f: f[1])[2]


def _unit(column: pa.Array, d: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code(index, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = index.value.words(_unit(batch.column("v"), d)).view(np.int64)
                yield pa.record_batch({"node": batch.column("node"), "c0": pa.array(words[:, 0].copy()), "c1": pa.array(words[:, 1].copy())})

    return run


def _buckets(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                held = index.value.buckets(_words(batch))
                n, tables, each = held.shape
                take = pa.array(np.repeat(np.arange(n), tables * each))
                cols = {c: batch.column(c).take(take) for c in ("node", "c0", "c1")}
                yield pa.record_batch({"t": pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), n)), "bucket": pa.array(held.ravel()), **cols})

    return run


def _words(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.column_stack([t.column(c).to_numpy() for c in ("c0", "c1")]).view(np.uint64)


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
    mine = t.column("mine").to_numpy()
    return np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)


def _near(index):
    """Of each cell: the nodes that have a partner within the radius in it."""

    def cell(t: pa.Table) -> pa.RecordBatch | None:
        a, b = _sides(t)
        words = _words(t)
        near = index.value.meets(words[a], words[b], t.column("t")[0].as_py(), t.column("bucket")[0].as_py())
        if t.column("lo")[0].as_py() == t.column("hi")[0].as_py():
            np.fill_diagonal(near, False)
        some = np.unique(np.concatenate([a[near.any(1)], b[near.any(0)]]))
        return t.select([*CELL, "mine", "node", "c0", "c1"]).take(pa.array(some)).combine_chunks().to_batches()[0] if len(some) else None

    return _each_cell(cell)


def _links(indexes, least: float):
    """Of each cell: (a, b, links): node a has ``links`` links here; a and b are linked through links here."""

    def cell(t: pa.Table) -> pa.RecordBatch | None:
        width, lo, hi = (t.column(c)[0].as_py() for c in ("width", "lo", "hi"))
        ids, n = (t.column(c).to_numpy() for c in ("node", "n"))
        a, b = _sides(t)
        unit = _unit(t.column("v").combine_chunks(), width)
        link = unit[a] @ unit[b].T >= least
        if (index := indexes.value.get(width)) is not None:
            words = _words(t)
            link &= index.meets(words[a], words[b], t.column("t")[0].as_py(), t.column("bucket")[0].as_py())
        i, j = np.nonzero(np.triu(link, 1) if lo == hi else link)
        if not len(i):
            return None
        i, j = a[i], b[j]
        degree = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
        root = np.arange(len(ids))
        while True:
            new = root.copy()
            np.minimum.at(new, i, root[j])
            np.minimum.at(new, j, root[i])
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = np.flatnonzero(degree)
        return pa.record_batch({"a": pa.array(ids[some]), "b": pa.array(ids[root[some]]), "links": pa.array(degree[some].astype(np.int64))})

    return _each_cell(cell)


def _each_cell(cell):
    """Rows sorted by CELL, one cell at a time."""

    def borders(t: pa.Table) -> np.ndarray:
        key = np.column_stack([t.column(c).to_numpy() for c in CELL])
        return np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]]) if len(key) else np.array([0, 0])

    def whole(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        cut = borders(t)
        for a, b in zip(cut[:-1], cut[1:] if last else cut[1:-1], strict=False):
            if b - a > 1 and (out := cell(t.slice(a, b - a))) is not None:
                yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            yield from whole(t, False)
            rest = t.slice(borders(t)[-2]) if t.num_rows else None
        if rest is not None:
            yield from whole(rest, True)

    return run


def _cells(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (width, t, bucket, node, ..) of buckets of two or more, once for each cell of two blocks that they meet in."""
    rows = materialize(rows, name)
    sizes = rows.groupBy("width", "t", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    sizes = materialize(sizes.select("width", "t", "bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), f"{name}-sizes")
    rows = rows.join(sizes, ["width", "t", "bucket"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("blocks", "other")


def _dealt(cells: DataFrame) -> DataFrame:
    return cells.repartition(*CELL).sortWithinPartitions(*CELL)


def near_duplicates(vectors: DataFrame, least: float = 0.9, recall: float = 0.98) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    ``vectors`` has vec_id and embedding (an array of any numbers). A vector that is null, empty, zero
    or holds a null or non-finite number links with nothing: 0 links, its own component, kept. Vectors
    of different width never link. Rows that repeat an id are vectors of their own; ``component_id``
    is the smallest non-null id reachable, null where there is none. ``recall``: share of the pairs at
    exactly cosine ``least`` that the tables should find (as drawn on the sample); closer pairs are
    found more often. Widths other than the WIDTHS most frequent are compared in full, in blocks.
    Other columns are ignored. No rows: no rows.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))  # -0 is 0
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # 128 bits tell vectors apart.
    rows = rows.withColumn("h", F.when(fine, F.xxhash64("v"))).withColumn("g", F.when(fine, F.xxhash64(F.lit(1), "v")))
    nodes = rows.where("h is not null").groupBy("h", "g").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("v")), "nodes")
    widths = {r["width"]: r["n"] for r in nodes.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(WIDTHS).collect()}
    indexes, met = {}, None
    for d, n in sorted(widths.items()):
        own = nodes.where(F.col("width") == d)
        most = max(1, min(SAMPLE, SAMPLE_VALUES // d))
        sample = own.orderBy(F.xxhash64("h"), "node").limit(most).select("v").toArrow().column("v").combine_chunks()
        indexes[d] = fit(_unit(sample, d), n, least, recall)
        index = spark.sparkContext.broadcast(indexes[d])
        codes = own.mapInArrow(_code(index, d), "node long, c0 long, c1 long")
        held = codes.mapInArrow(_buckets(index), "t int, bucket long, node long, c0 long, c1 long").withColumn("width", F.lit(d))
        cells = _dealt(_cells(held, "codes").select(*CELL, "mine", "node", "c0", "c1"))
        near = cells.mapInArrow(_near(index), "width int, t int, bucket long, lo int, hi int, mine int, node long, c0 long, c1 long")
        met = near if met is None else met.unionByName(near)
    out = "a long, b long, links long"
    found = spark.createDataFrame([], out)
    if met is not None:
        rare = nodes.where(~F.col("width").isin(list(widths))).select("width", F.lit(0).alias("t"), F.lit(0).cast("long").alias("bucket"), "node", F.lit(0).cast("long").alias("c0"), F.lit(0).cast("long").alias("c1"))
        met = materialize(met.unionByName(_cells(rare, "rare").select(*met.columns)), "met")
        ready = _dealt(met.join(nodes.select("node", "n", "v"), "node").select(*CELL, "mine", "node", "c0", "c1", "n", "v"))
        found = ready.mapInArrow(_links(spark.sparkContext.broadcast(indexes), least), out)
    found = materialize(found, "links")
    part = materialize(connected_components(found, "a", "b"), "parts")
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    nodes = nodes.select("h", "g", "node", "n", "least").join(links, F.col("node") == F.col("a"), "left").drop("a")
    nodes = nodes.join(part.withColumnRenamed("node", "end"), F.col("node") == F.col("end"), "left")
    nodes = nodes.select("h", "g", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("part"))
    ends = materialize(nodes.groupBy("part").agg(F.min("least").alias("component_id")), "ends")
    nodes = materialize(nodes.join(ends, "part").select("h", "g", "links", "component_id"), "components")
    out = rows.select("vec_id", "h", "g").join(nodes, ["h", "g"], "left")
    component = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
