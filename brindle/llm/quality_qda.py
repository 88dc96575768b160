"""Operator 5: quality classifier by regularised quadratic discriminant analysis.

One scan turns every whole text into transformed statistics (logarithms of lengths and rates).
Class counts, sums and cross products over all labelled training rows give means and covariances;
a class's covariance is shrunk towards the pooled one and towards its diagonal. The score is the
logistic of a line over the difference of the two Gaussian log densities (Mahalanobis distances by
the Cholesky factors that the model keeps, plus the log prior odds). The line is fitted to the
training rows' differences, counted in fixed bins, as Gaussian densities overstate their odds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import textkernel as tk
from brindle.llm.common import materialize, read_table

NAMES = (
    "words", "word_bytes", "word_spread", "longest", "symbols", "pipes", "upper", "upper_words", "digits", "digit_words", "repeats",
    "distinct", "top_word", "bare_words", "line_words", "line_copies", "stops", "shouts", "ragged", "odd_bytes",
)


RANGE, STEP, SPREAD = 500.0, 0.25, 20.0  # of log density differences: bound, bin width, unit of the fitted line


def _kinds() -> np.ndarray:
    """Kind of byte: bit 0 symbol, 1 upper case, 2 digit, 3 letter (any byte over 127 too), 4 stop mark, 5 shout, 6 control."""
    k = np.zeros(256, np.uint8)
    k[list(b"#$%&*+/<=>@[\\]^_`{|}~")] |= 1
    k[65:91] |= 2
    k[48:58] |= 4
    k[65:91] |= 8
    k[97:123] |= 8
    k[128:] |= 8
    k[list(b".,;:")] |= 16
    k[list(b"!?")] |= 32
    k[:32] |= 64
    k[[9, 10, 13]] = 0
    return k


_KIND = _kinds()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of len(NAMES) finite numbers per text, of words and bytes; an empty text has zero rates."""
    rows = len(offsets) - 1
    starts, ends, first = tk.words(data, offsets)
    h = tk.word_hashes(tk.lower(data), starts, ends)
    n = np.diff(first).astype(float)
    kind = _KIND[data]
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(float)
    per_word = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x, dtype=float)])[first])
    bytes_ = np.maximum(np.diff(offsets), 1).astype(float)
    some = np.maximum(n, 1)
    size = (ends - starts).astype(float)
    mean = per_word(size) / some
    spread = np.sqrt(np.maximum(per_word(size**2) / some - mean**2, 0))
    inside = lambda bit: np.concatenate([[0], np.cumsum((kind & bit) > 0)])
    within = lambda c: c[ends] - c[starts]
    letters, uppers, digits, marks = (within(inside(b)) for b in (8, 2, 4, 1))
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][first[:-1] < len(h)]] = False
    distinct, top, longest, copies, lines = (np.zeros(rows) for _ in range(5))
    breaks = np.flatnonzero(data == 10)
    for i in range(rows):
        own = h[first[i] : first[i + 1]]
        if len(own):
            _, c = np.unique(own, return_counts=True)
            distinct[i], top[i], longest[i] = len(c), c.max(), size[first[i] : first[i + 1]].max()
        text = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
        text = [x for x in text if x.strip()]
        lines[i] = len(text)
        copies[i] = len(text) - len(set(text))
    lg = lambda x, least: np.log(x + least)
    return np.column_stack([
        np.log1p(n), lg(mean, 0.1), lg(spread, 0.1), np.log1p(longest), lg(count((kind & 1) > 0) / bytes_, 1e-3), lg(count(data == 124) / some, 1e-2),
        lg(count((kind & 2) > 0) / bytes_, 1e-3), lg(per_word((uppers > 1) & (uppers == letters)) / some, 1e-2), lg(count((kind & 4) > 0) / bytes_, 1e-3),
        lg(per_word(digits > 0) / some, 1e-2), lg(per_word(again) / some, 1e-2), lg(distinct, 1) - 0.75 * np.log1p(n), lg(top / some, 2e-2), lg(per_word(letters == 0) / some, 1e-2),
        lg(n / np.maximum(lines, 1), 1), lg(copies / np.maximum(lines, 1), 1e-2), lg(count((kind & 16) > 0) / some, 1e-2), lg(count((kind & 32) > 0) / some, 1e-2),
        lg(per_word((marks > 0) & (letters > 0)) / some, 1e-2), lg(count((kind & 64) > 0) / bytes_, 1e-4),
    ])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in tk.slices(batch.column("text")):
            x = statistics(data, offsets)
            flat = pa.array(x.ravel())
            yield pa.record_batch({"doc_id": batch.column("doc_id").slice(row, len(x)), "key": batch.column("key").slice(row, len(x)), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)})


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: count, sums and upper cross products of the rows seen, as (label, at, value)."""
    d = len(NAMES)
    up = np.triu_indices(d)
    total = np.zeros((2, 1 + d + len(up[0])))
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy().reshape(-1, d)
        y = batch.column("label").to_numpy()
        for c in (0, 1):
            z = x[y == c]
            total[c] += np.concatenate([[len(z)], z.sum(0), (z.T @ z)[up]])
    m = total.shape[1]
    yield pa.record_batch({"label": pa.array(np.repeat([0, 1], m), pa.int32()), "at": pa.array(np.tile(np.arange(m), 2), pa.int32()), "value": pa.array(total.ravel())})


def _substituted(factor: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """The solution of ``factor @ u = rhs`` for a lower triangular factor, row by row."""
    u = np.empty_like(rhs)
    for i in range(len(factor)):
        u[i] = (rhs[i] - factor[i, :i] @ u[:i]) / factor[i, i]
    return u


@dataclass(frozen=True)
class Model:
    """Means, Cholesky factors and half log determinants of classes 0 and 1, and the log prior odds of 1."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    half_logdet: tuple[float, float]
    odds: float
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        d = []
        for c in (0, 1):
            u = _substituted(self.factors[c], (z - self.means[c]).T)
            d.append(-0.5 * (u * u).sum(0) - self.half_logdet[c])
        return np.clip(d[1] - d[0] + self.odds, -RANGE, RANGE)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -700, 700)))


def fit(moments: np.ndarray, shrink: float = 0.1, flatten: float = 0.05) -> Model:
    """From the (2, 1 + d + d(d+1)/2) moments. ``shrink``: share of the pooled covariance; ``flatten``: of its diagonal.

    A class without rows takes the pooled moments; without any rows the model scores 0.5.
    """
    d = len(NAMES)
    up = np.triu_indices(d)
    n, s = moments[:, 0], moments[:, 1 : 1 + d]
    q = np.zeros((2, d, d))
    for c in (0, 1):
        q[c][up] = moments[c, 1 + d :]
        q[c] = q[c] + q[c].T - np.diag(np.diag(q[c]))
    all_ = max(n.sum(), 1)
    centre = s.sum(0) / all_
    scale = np.sqrt(np.maximum(np.diag(q.sum(0)) / all_ - centre**2, 1e-4))
    means, covs = [], []
    for c in (0, 1):
        m = s[c] / n[c] if n[c] else centre
        v = q[c] / n[c] - np.outer(m, m) if n[c] else np.diag(scale**2)
        means.append((m - centre) / scale)
        covs.append(v / np.outer(scale, scale))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / all_ if n.sum() else np.eye(d)
    factors, dets = [], []
    for c in (0, 1):
        v = (1 - shrink) * covs[c] + shrink * pooled
        v = (1 - flatten) * v + flatten * np.diag(np.diag(v)) + 1e-3 * np.eye(d)
        factors.append(np.linalg.cholesky(v))
        dets.append(float(np.log(np.diag(factors[-1])).sum()))
    odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    return Model(centre, scale, tuple(means), tuple(factors), tuple(dets), odds)


def _bins(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
            d = model.value.difference(x) if len(x) else np.empty(0)
            yield pa.record_batch({"label": batch.column("label"), "bin": pa.array(np.rint(d / STEP).astype(np.int32))})

    return run


def calibrate(model: Model, counts: dict[tuple[int, int], int], ridge: float = 1.0, rounds: int = 50) -> Model:
    """The model with slope and shift by penalised logistic regression on (label, bin) counts."""
    if not counts:
        return model
    keys = sorted(counts)
    y = np.array([k[0] for k in keys], float)
    x = np.column_stack([[k[1] * STEP / SPREAD for k in keys], np.ones(len(keys))])
    w = np.array([counts[k] for k in keys], float)
    b, prior = np.array([SPREAD * 0.1, 0.0]), np.diag([ridge / SPREAD, 0.01])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - prior @ b
        h = (x * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + prior
        step = np.linalg.solve(h, g)
        b = b + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return replace(model, slope=float(max(b[0], 1e-6) / SPREAD), shift=float(b[1]))


def _score(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
            s = model.value.score(x) if len(x) else np.empty(0)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    return run


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, key (xxhash64 of the text), held_out, score, predicted.

    Trains on all rows of ``labels`` (doc_id, quality 0 or 1; others are ignored) whose document's
    crc32 of the id's digits is not 0 modulo 5; only statistics of the text enter a score. Null
    text counts as empty. A document whose id is null has no label and is not held out; rows that
    repeat an id are scored each, and each trains. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    stats = materialize(rows.mapInArrow(_scan, "doc_id long, key long, x array<double>"), "statistics")
    marks = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    train = stats.where(~held_out()).join(marks, "doc_id").select("label", "x")
    sums = train.mapInArrow(_moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    d = len(NAMES)
    moments = np.zeros((2, 1 + d + d * (d + 1) // 2))
    for label, at, value in sums.collect():  # a fixed number of rows
        moments[label, at] = value
    model = fit(moments)
    raw = spark.sparkContext.broadcast(model)
    bins = train.mapInArrow(_bins(raw), "label int, bin int").groupBy("label", "bin").count()
    counts = {(r["label"], r["bin"]): r["count"] for r in bins.collect()}  # at most 4 * RANGE / STEP + 2 rows
    model = spark.sparkContext.broadcast(calibrate(model, counts))
    out = stats.mapInArrow(_score(model, threshold), "doc_id long, key long, score double, predicted int")
    return out.select("doc_id", "key", held_out().alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("key")


def remainder(doc_id: int) -> int:
    """The fold of an id, as :func:`held_out` has it."""
    return zlib.crc32(str(doc_id).encode()) % 5
