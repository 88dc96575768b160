"""Operator 4: substring deduplication by a log-structured fingerprint index.

A window is ``width`` consecutive words of one document. A word goes when a window over it also
starts in a document with a smaller id. Documents come in batches of ascending id; the index holds
what earlier batches had, as immutable runs sorted by fingerprint.

Windows are not indexed one by one. Each takes as anchor the least hash among its ``gram``-word
grams; equal windows have equal anchors at equal places. Neighbouring windows with one anchor make
a span, and an index entry is (anchor hash, span hash) -> smallest id. Of a span that several rows of
a task hold, only those of the smallest id leave the task; the others repeat it. The entries go to
buckets by anchor hash, packed; a bucket merges them with the sorted runs:
  - a span that a smaller id has repeats: all its windows do;
  - an anchor that a smaller id has only in other spans leaves the span open, to be verified
    window by window, against one document for each different span of that anchor;
  - spans new to the index become the bucket's piece of the next run.
Runs are compacted when they are many, by the merge that reads them anyway. A bucket's memory follows the distinct spans and the tasks
that hold them, never the number of copies.

Spans are told apart by 64 bits under their anchor's 64 (S spans of one anchor: S**2/2**65 expected
false matches, 3% at a billion), windows of open spans by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import textkernel as tk
from brindle.llm.common import load_tables, materialize, read_table, rows_with_ids, rows_without_ids, save_tables

FLUSH = 1 << 19  # spans that a task packs at once
LAST = (1 << 63) - 1  # stands for a null id: larger than all
# Of spans still on their way ``own`` counts each document's; docs, own, start and count are pressed.
BLOB = "pid int, old boolean, docs binary, prints binary, own binary, anchor binary, span binary, start binary, count binary"
BLOBS = [x.split()[0] for x in BLOB.split(", ")]
BLOB_KINDS = [pa.int32(), pa.bool_(), *[pa.binary()] * 7]


def _pressed(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes(), 1)


def _loose(pressed: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(pressed), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def spans(h: np.ndarray, first: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start word in row, windows, anchor, span) of all spans of rows whose words begin at ``first``."""
    m = len(h) - width + 1
    if m <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams, whole, n = tk.window_hashes(h, gram, 11), tk.window_hashes(h, width, 13), width - gram + 1
    least = grams[:m].copy()
    for o in range(1, n):
        np.minimum(least, grams[o : o + m], out=least)
    at = np.zeros(m, np.int64)
    for o in range(n - 1, -1, -1):
        at[grams[o : o + m] == least] = o
    at += np.arange(m)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    p = np.flatnonzero(row[:m] == row[width - 1 :])
    if not len(p):
        return spans(h[:0], first[:1], width, gram)
    a = at[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(p)))
    s = p[begin]
    # First and last window overlap (a span has at most width - gram + 1), so they fix all words.
    span = tk.mix(whole[s] * np.uint64(0x9E3779B97F4A7C15) + tk.mix(whole[s + count - 1] + count.astype(np.uint64)))
    return row[s], s - first[row[s]], count, grams[a[begin]], span


def _pack(buckets: int, width: int, gram: int):
    """Packed spans by bucket; those that a smaller id of the task has are known to repeat (``old`` is null)."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        row, start, count, anchor, span, ids, prints = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(anchor ^ tk.mix(span))
        new = np.ones(len(order), bool)
        new[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (span[order[1:]] != span[order[:-1]])
        own = ids[row]
        later = np.empty(len(order), bool)
        later[order] = own[order] > np.minimum.reduceat(own[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        pid = (anchor >> np.uint64(32)).astype(np.int64) % buckets
        pid[later] = buckets
        order = np.argsort(pid, kind="stable")
        border = np.searchsorted(pid[order], np.arange(buckets + 2))
        rows = []
        for b in np.flatnonzero(np.diff(border)).tolist():
            i = order[border[b] : border[b + 1]]
            docs, own = np.unique(row[i], return_counts=True)
            about = (_pressed(np.diff(ids[docs], prepend=np.int64(0))), prints[docs].tobytes(), _pressed(own.astype(np.uint32)))
            place = (_pressed(start[i].astype(np.uint32)), _pressed(count[i].astype(np.uint8)))
            if b == buckets:  # a smaller id of this task has these
                rows.append((int(ids[docs[0]]) % buckets, None, *about, None, None, *place))
            else:
                rows.append((b, False, *about, anchor[i].tobytes(), span[i].tobytes(), *place))
        yield pa.record_batch([pa.array([r[j] for r in rows], k) for j, k in enumerate(BLOB_KINDS)], BLOBS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, base = [], 0, 0
        for batch in batches:
            ids, prints = batch.column("id").to_numpy(), batch.column("print").to_numpy()
            for at, data, offsets in tk.slices(batch.column("text")):
                starts, ends, first = tk.words(data, offsets)
                rows = len(offsets) - 1
                r, *rest = spans(tk.word_hashes(data, starts, ends), first, width, gram)
                held.append((r + base, *rest, ids[at : at + rows], prints[at : at + rows]))
                base, n = base + rows, n + len(r)
                if n >= FLUSH:
                    yield from flush(held)
                    held, n, base = [], 0, 0
        if n:
            yield from flush(held)

    return run


FOUND = "kind int, id long, print long, at int, windows int, key long, " + BLOB


def _merge(keep: bool, fold: bool):
    """Of each bucket: repeated spans (kind 0), open ones (1) and its piece of the new run (2), with all old ones if ``fold``."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), *BLOB_KINDS]

    def rows_of(kind: int, id_: np.ndarray, print_: np.ndarray | None, start: np.ndarray, count: np.ndarray, anchor: np.ndarray | None) -> pa.RecordBatch:
        n = len(id_)
        none = pa.nulls(n, pa.int64())
        cols = [pa.array(np.full(n, kind, np.int32)), pa.array(id_), none if print_ is None else pa.array(print_), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), none if anchor is None else pa.array(anchor.view(np.int64))]
        return pa.record_batch(cols + [pa.nulls(n, k) for k in BLOB_KINDS], names)

    def merged(pid: int, blobs: list[dict]) -> Iterator[pa.RecordBatch]:
        part: dict[str, list] = {k: [] for k in ("id", "print", "start", "count", "anchor", "span", "old")}
        for b in blobs:
            docs = _loose(b["docs"], np.int64)
            part["start"].append(_loose(b["start"], np.uint32))
            part["count"].append(_loose(b["count"], np.uint8))
            if b["old"]:
                part["id"].append(docs)
                part["print"].append(np.zeros(len(docs), np.int64))
            else:
                own = np.repeat(np.arange(len(docs)), _loose(b["own"], np.uint32))
                part["id"].append(np.cumsum(docs)[own])
                part["print"].append(np.frombuffer(b["prints"], np.int64)[own])
            if b["old"] is None:
                yield rows_of(0, *(part[k].pop() for k in ("id", "print", "start", "count")), None)
                continue
            part["anchor"].append(np.frombuffer(b["anchor"], np.uint64))
            part["span"].append(np.frombuffer(b["span"], np.uint64))
            part["old"].append(np.full(len(part["id"][-1]), b["old"]))
        if not part["id"]:
            return
        e = {k: np.concatenate(v) for k, v in part.items()}
        order = np.lexsort((e["start"], e["id"], e["span"], e["anchor"]))
        e = {k: v[order] for k, v in e.items()}
        n = len(order)
        new_anchor = np.ones(n, bool)
        new_anchor[1:] = e["anchor"][1:] != e["anchor"][:-1]
        new_span = new_anchor.copy()
        new_span[1:] |= e["span"][1:] != e["span"][:-1]
        heads, tops = np.flatnonzero(new_span), np.flatnonzero(new_anchor)
        in_span, in_anchor = np.cumsum(new_span) - 1, np.cumsum(new_anchor) - 1
        least = e["id"][heads][in_span]
        least_any = np.minimum.reduceat(e["id"], tops)[in_anchor]
        fresh = ~e["old"]
        repeat = fresh & (least < e["id"])
        yield rows_of(0, *(e[k][repeat] for k in ("id", "print", "start", "count")), None)
        open_ = fresh & ~repeat & (least_any < e["id"])
        if open_.any():
            yield rows_of(1, *(e[k][open_] for k in ("id", "print", "start", "count", "anchor")))
            asked = np.zeros(len(tops), bool)
            asked[in_anchor[open_]] = True
            head = heads[asked[in_anchor[heads]]]
            head = head[~open_[head]]
            yield rows_of(1, e["id"][head], None, e["start"][head], e["count"][head], e["anchor"][head])
        if keep:
            head = heads if fold else heads[fresh[heads]]
            if len(head):
                row = (2, None, None, None, None, None, pid, True, _pressed(e["id"][head]), None, None, e["anchor"][head].tobytes(), e["span"][head].tobytes(), _pressed(e["start"][head]), _pressed(e["count"][head]))
                yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, blobs = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                if row["pid"] != pid and blobs:
                    yield from merged(pid, blobs)
                    blobs = []
                pid = row["pid"]
                blobs.append(row)
        if blobs:
            yield from merged(pid, blobs)

    return run


class FingerprintIndex:
    """Runs of (anchor, span) -> (smallest id, place), for one ``width``, ``gram`` and number of buckets.

    ``texts``: the documents of earlier calls (id, print, text), against which open spans are verified.
    Where a batch would make more than ``most_runs`` runs, its merge writes one that holds them all (ids
    of a later run are larger, so the first entry of a span wins). ``save`` and ``load`` carry an index from session
    to session.
    """

    def __init__(self, buckets: int, width: int = 13, gram: int = 5, most_runs: int = 4) -> None:
        self.buckets, self.width, self.gram, self.most_runs = buckets, width, gram, most_runs
        self.runs: list[DataFrame] = []
        self.texts: list[DataFrame] = []

    def add(self, batch: DataFrame, keep: bool = True) -> tuple[DataFrame, DataFrame]:
        """(repeated, open) spans of ``batch`` (id, print, text), whose ids are above all indexed ones.

        repeated: id, print, start, count. open: the same and anchor, with null print for the
        indexed spans that they must be held against. ``keep``: add the batch to the index.
        """
        blobs = batch.mapInArrow(_pack(self.buckets, self.width, self.gram), BLOB)
        for r in self.runs:
            blobs = blobs.unionByName(r)
        fold = len(self.runs) >= self.most_runs
        # A task works through several buckets, one after the other.
        found = materialize(blobs.repartition(max(1, self.buckets // 2), "pid").sortWithinPartitions("pid").mapInArrow(_merge(keep, fold), FOUND), "found")
        if keep:
            self.runs = [*([] if fold else self.runs), found.where("kind = 2").select(*BLOBS)]
        span = ("id", "print", F.col("at").alias("start"), F.col("windows").alias("count"))
        return found.where("kind = 0").select(*span), found.where("kind = 1").select(*span, F.col("key").alias("anchor"))

    def save(self, folder: str) -> str:
        """Write the index as the next version in ``folder``."""
        if not self.runs:
            raise ValueError("the index holds nothing yet")
        spark = self.runs[0].sparkSession
        about = spark.createDataFrame([(self.buckets, self.width, self.gram, self.most_runs)], "buckets int, width int, gram int, most_runs int")
        runs = {f"run-{i:04d}": r for i, r in enumerate(self.runs)}
        return save_tables({"about": about, **runs, **{f"texts-{i:04d}": t for i, t in enumerate(self.texts)}}, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> FingerprintIndex | None:
        """The index as last saved in ``folder``, or None."""
        tables = load_tables(spark, folder)
        if not tables:
            return None
        index = cls(**tables["about"].first().asDict())
        index.runs = [t for k, t in tables.items() if k.startswith("run-")]
        index.texts = [t for k, t in tables.items() if k.startswith("texts-")]
        return index


WINDOWS = "w long, v long, id long, print long, start int, asks boolean, known boolean"


def _windows(width: int):
    """Hashes of the windows that open spans hold.

    Of a window that several rows of a task hold, only those of the smallest id are handed on; what
    others ask is ``known`` then: a smaller id has it.
    """

    def flush(held: list) -> pa.RecordBatch:
        w, v, ids, prints, start, asks = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, v, w))
        w, v, ids, prints, start, asks = (x[order] for x in (w, v, ids, prints, start, asks))
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (v[1:] != v[:-1])
        later = ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        stay = ~later | asks
        cols = {"w": w.view(np.int64), "v": v.view(np.int64), "id": ids, "print": prints, "start": start, "asks": asks, "known": later}
        return pa.record_batch({k: pa.array(x[stay]) for k, x in cols.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, prints = batch.column("id").to_pylist(), batch.column("print").to_pylist()
            for at, data, offsets in tk.slices(batch.column("text")):
                starts, ends, first = tk.words(data, offsets)
                h = tk.word_hashes(data, starts, ends)
                whole, again = tk.window_hashes(h, width, 13), tk.window_hashes(h, width, 17)
                wanted = batch.column("wanted").slice(at, len(offsets) - 1).to_pylist()
                for i in range(len(offsets) - 1):
                    last = first[i + 1] - first[i] - width
                    place = [(s + j, w["asks"]) for w in wanted[i] for s in [w["start"]] for j in range(w["count"]) if s + j <= last]
                    if not place:
                        continue
                    p, m = np.array([x for x, _ in place], np.int64), len(place)
                    held.append((whole[first[i] + p], again[first[i] + p], np.full(m, ids[at + i]), np.full(m, prints[at + i]), p.astype(np.int32), np.array([a for _, a in place], bool)))
                    n += m
                if n >= FLUSH // 4:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


def _by_document(spans_: DataFrame, *what) -> DataFrame:
    return spans_.groupBy("id", "print").agg(F.collect_list(F.struct(*what)).alias("wanted"))


def verify(docs: DataFrame, open_: DataFrame, width: int) -> DataFrame:
    """(id, print, start, count) of single windows of open spans that a smaller id also has."""
    if open_.isEmpty():
        return open_.select("id", "print", "start", "count")
    asks = open_.where("print is not null").select("id", "print", "start", "count", F.lit(True).alias("asks"))
    held = open_.where("print is null").select("id", "start", "count").distinct()
    ids = materialize(open_.select("id").distinct(), "open-ids")
    near = rows_with_ids(docs, ids, "id")
    prints = materialize(near.select("id", "print"), "open-rows")
    held = held.join(prints, "id").select("id", "print", "start", "count", F.lit(False).alias("asks"))
    wanted = materialize(_by_document(asks.unionByName(held).distinct(), "start", "count", "asks"), "wanted")
    rows = near.join(wanted, ["id", "print"]).dropDuplicates(["id", "print"]).select("id", "print", "text", "wanted")
    rows = materialize(rows.mapInArrow(_windows(width), WINDOWS), "windows")
    asked = rows.where("asks").select("w", "v", "id", "print", "start", "known")
    least = rows.where("not known").groupBy("w", "v").agg(F.min("id").alias("least"))
    found = asked.where("not known").join(least, ["w", "v"]).where("least < id").unionByName(asked.where("known"), allowMissingColumns=True)
    return found.select("id", "print", "start", F.lit(1).alias("count"))


def _apply(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for at, data, offsets in tk.slices(batch.column("text")):
                raw, wanted = data.tobytes(), batch.column("wanted").slice(at, len(offsets) - 1).to_pylist()
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    own = raw[a:b].split()  # bytes: splits at space and tab .. carriage return only
                    dead = np.zeros(len(own) + 1, np.int64)
                    for w in wanted[i] or ():
                        dead[w["start"]] += 1
                        dead[min(len(own), w["start"] + w["count"] + width - 1)] -= 1
                    dead = np.cumsum(dead[:-1]) > 0
                    n.append(len(own))
                    gone.append(int(dead.sum()))
                    kept.append(b" ".join([x for x, d in zip(own, dead.tolist(), strict=True) if not d] if gone[-1] else own))
            out = {"id": batch.column("id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
            if with_text:
                out["text"] = pa.array([x.decode() for x in kept], pa.string())
            yield pa.record_batch(out)

    return run


def substring_dedup(docs: DataFrame, width: int = 13, gram: int = 5, batches: int = 2, buckets: int | None = None, index: FingerprintIndex | None = None, with_text: bool = False, most_runs: int = 4) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (and text, the kept words joined by one space).

    Words are runs of anything but space and tab..carriage return, unchanged. Null and empty texts
    have no words; texts of fewer than ``width`` words no window. Rows that repeat an id are not
    smaller than each other. A null id counts as larger than any other. Other columns are ignored.
    ``batches``: parts by ascending id, merged with the index one after the other (more of them:
    less memory a bucket); the index that a call makes compacts more than ``most_runs`` runs. ``buckets`` defaults to four for each partition of the input.
    ``index``: documents of earlier calls with it count as smaller where their ids are; it keeps all
    documents of this call, texts included. Ids should ascend from call to call, as what an earlier
    call returned stays. Its ``width`` and ``gram`` must be those of the call. No rows: no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(LAST))).withColumn("print", F.xxhash64("text")).drop("doc_id")
    texts = rows.where("text is not null")
    carried = index is not None
    if carried and (index.width, index.gram) != (width, gram):
        raise ValueError("the index has another width or gram")
    index = index or FingerprintIndex(buckets or max(32, 4 * docs.rdd.getNumPartitions()), width, gram, most_runs)
    cuts = rows.select(F.percentile_approx("id", [i / batches for i in range(1, batches)], 10000).alias("c")).first()["c"] if batches > 1 else []
    edges = sorted(set(cuts or []))
    repeated, open_ = [], []
    for i, low in enumerate([None, *edges]):
        part = texts if low is None else texts.where(F.col("id") > low)
        part = part if i == len(edges) else part.where(F.col("id") <= edges[i])
        r, o = index.add(part, keep=carried or i < len(edges))
        repeated.append(r)
        open_.append(o)
    spans_ = repeated[0]
    for r in repeated[1:]:
        spans_ = spans_.unionByName(r)
    asked = open_[0]
    for o in open_[1:]:
        asked = asked.unionByName(o)
    known = texts.select("id", "print", "text")
    for earlier in index.texts:
        known = known.unionByName(earlier)
    spans_ = spans_.unionByName(verify(known, asked, width))
    if carried:
        index.texts.append(materialize(texts.select("id", "print", "text"), "history"))
    gone = materialize(_by_document(spans_, "start", "count"), "gone")
    cut = rows_with_ids(rows, gone, "id").join(gone, ["id", "print"], "left").select("id", "text", "wanted")
    whole = rows_without_ids(rows, gone, "id").select("id", "text", F.lit(None).cast("array<struct<start:int,count:int>>").alias("wanted"))
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    out = cut.unionByName(whole).mapInArrow(_apply(width, with_text), schema)
    return out.withColumn("id", F.when(F.col("id") != LAST, F.col("id"))).withColumnRenamed("id", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: the second merges with one run, and compacts it with its own for the third."""
    docs = read_table(spark, sf_dir, "documents")
    return substring_dedup(docs, batches=3, most_runs=1)


ORACLE = """
WITH w AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS word
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM documents)
), win AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER f AS win, count(*) OVER f AS n
  FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM win WHERE n = 13) WHERE least < doc_id
), marked AS (
  SELECT w.doc_id, w.i, word, max(hit.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS covered
  FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id AND hit.i = w.i
), g AS (
  SELECT doc_id, count(*) AS n_words, count(covered) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE covered IS NULL) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""
