"""Operator 7: exact deduplication by composable polynomial fingerprints.

A text is cut into chunks; a chunk's hash is the value of its bytes as a polynomial modulo two
primes. Hashes compose by length-shifted arithmetic, ``H(xy) = H(x) * B**len(y) + H(y)``, so chunks
of a huge text are hashed by different tasks and summed, each shifted by what follows it. Rows of
equal fingerprint and length are then compared chunk by chunk: all chunks of a group at one place are
equal when the least of them is the largest. A fingerprint that unequal texts share is split by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm import textkernel as tk
from brindle.llm.common import ascii_lower, materialize, read_table, rows_with_ids

PRIMES = ((2147483647, 911382323), (2147483629, 972663749))  # (modulus, base)
CHUNK = 1 << 16


def _powers(chunk: int) -> list[np.ndarray]:
    out = []
    for p, b in PRIMES:
        t = [1]
        for _ in range(chunk):
            t.append(t[-1] * b % p)
        out.append(np.array(t, np.int64))
    return out


def _chunk_hash(data: np.ndarray, powers: list[np.ndarray]) -> list[int]:
    x = data.astype(np.int64) + 1
    n = len(x)
    return [int(np.dot(x, t[:n][::-1]) % p) if n else 0 for t, (p, _) in zip(powers, PRIMES, strict=True)]


def combine(x: list[int], y: list[int], y_bytes: int) -> list[int]:
    """Fingerprint of a text from those of its two halves and the second half's length."""
    return [(a * pow(b, y_bytes, p) + c) % p for a, c, (p, b) in zip(x, y, PRIMES, strict=True)]


def fingerprint(data: np.ndarray, powers: list[np.ndarray], chunk: int = CHUNK) -> list[int]:
    total = [0] * len(PRIMES)
    for i in range(0, len(data), chunk):
        part = data[i : i + chunk]
        total = combine(total, _chunk_hash(part, powers), len(part))
    return total


def _scan(chunk: int, keep_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(chunk)
        for batch in batches:
            prints, sizes, digests = [], [], []
            for _, data, offsets in tk.slices(batch.column("text")):
                data = tk.lower(data)
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    h = fingerprint(data[a:b], powers, chunk)
                    prints.append((h[0] << 31 | h[1]) & ((1 << keep_bits) - 1))
                    sizes.append(b - a)
                    digests.append(hashlib.sha256(data[a:b]).hexdigest())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(prints, pa.int64()), "bytes": pa.array(sizes, pa.int64()), "sha": pa.array(digests, pa.string())})

    return run


def _scan_chunks(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(chunk)
        for batch in batches:
            hs, sizes = [], []
            for _, data, offsets in tk.slices(batch.column("part")):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    hs.append(fingerprint(data[a:b], powers, chunk))
                    sizes.append(b - a)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "sha": batch.column("sha"), "seq": batch.column("seq"), "bytes": pa.array(sizes, pa.int64()), "h1": pa.array([h[0] for h in hs], pa.int64()), "h2": pa.array([h[1] for h in hs], pa.int64())})

    return run


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = batch.to_pydict()
        for i, (p, b) in enumerate(PRIMES, 1):
            t[f"h{i}"] = [h * pow(b, n, p) % p for h, n in zip(t[f"h{i}"], t["after"], strict=True)]
        yield pa.record_batch({k: pa.array(t[k], batch.schema.field(k).type) for k in ("doc_id", "sha", "bytes", "h1", "h2")})


def _huge(docs: DataFrame, chunk: int, huge: int, keep_bits: int) -> DataFrame:
    """Fingerprints of the texts of more than ``huge`` characters, their chunks hashed by different tasks."""
    low = docs.withColumn("text", ascii_lower(F.col("text"))).withColumn("sha", F.sha2("text", 256))
    # Repeated rows are one text here; they come back by the join on (doc_id, sha).
    size = F.lit(chunk)
    parts = low.select("doc_id", "sha", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int")), lambda i: F.substr("text", i * size + 1, size))).alias("seq", "part"))
    parts = parts.repartition(F.col("sha"), F.col("seq")).dropDuplicates(["doc_id", "sha", "seq"])
    hashed = materialize(parts.mapInArrow(_scan_chunks(chunk), "doc_id long, sha string, seq int, bytes long, h1 long, h2 long"), "chunks")
    rest = Window.partitionBy("doc_id", "sha").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    hashed = hashed.select("doc_id", "sha", "bytes", "h1", "h2", F.coalesce(F.sum("bytes").over(rest), F.lit(0)).alias("after"))
    hashed = hashed.mapInArrow(_shift, "doc_id long, sha string, bytes long, h1 long, h2 long")
    fp = F.call_function("shiftleft", F.col("h1"), F.lit(31)).bitwiseOR(F.col("h2")).bitwiseAND(F.lit((1 << keep_bits) - 1))
    hashed = hashed.groupBy("doc_id", "sha").agg(*(F.pmod(F.sum(f"h{i}"), F.lit(p)).alias(f"h{i}") for i, (p, _) in enumerate(PRIMES, 1)), F.sum("bytes").alias("bytes"))
    hashed = hashed.select("doc_id", "sha", fp.alias("fp"), "bytes")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.sha") == F.col("r.sha"))
    return low.select("doc_id", "sha").alias("l").join(hashed.alias("r"), same).select("l.doc_id", "r.fp", "r.bytes", "l.sha")


def exact_dedup(docs: DataFrame, chunk: int = CHUNK, huge: int = CHUNK, keep_bits: int = 62, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts
    are equal. The largest id of a group stays (``keep_id``; a null id only if all are null);
    ``kept`` says whether the row has that id, so rows that repeat both id and text are marked
    alike. ``huge``: characters beyond which a text's chunks go to different tasks.
    ``keep_bits`` below 62 weakens the fingerprint, for tests. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    long_ = F.length("text") > huge
    out = "doc_id long, fp long, bytes long, sha string"
    rows = materialize(docs.where(~long_).mapInArrow(_scan(chunk, keep_bits), out).unionByName(_huge(docs.where(long_), chunk, huge, keep_bits)), "prints")

    key = ["fp", "bytes"]
    # Groups are written before rows are joined with them, so that a hot group's rows can be split.
    groups = materialize(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "groups")
    members = materialize(rows.join(groups, key).select("doc_id", "sha", *key).distinct(), "members")
    low = rows_with_ids(docs, members).withColumn("text", ascii_lower(F.col("text"))).withColumn("sha", F.sha2("text", 256))
    same = F.col("l.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("l.sha") == F.col("m.sha"))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / chunk).cast("int")), lambda i: F.substr("text", i * chunk + 1, F.lit(chunk)))
    parts = low.alias("l").join(members.alias("m"), same).select("m.fp", "m.bytes", F.posexplode(parts).alias("seq", "part"))
    # Chunks in the same place are equal when the least is the largest; each task sends one of either.
    apart = parts.groupBy(*key, "seq").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most")
    clash = materialize(apart.select(*key).distinct().withColumn("clash", F.lit(True)), "clashes")

    rows = rows.join(clash, key, "left").withColumn("part", F.when(F.col("clash"), F.col("sha")).otherwise(F.lit(""))).drop("clash")
    groups = materialize(rows.groupBy(*key, "part").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "kept")
    rows = rows.join(groups, [*key, "part"])
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(low) AS text_sha256
FROM t WINDOW g AS (PARTITION BY low)
"""
