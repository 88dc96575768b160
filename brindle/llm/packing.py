"""Operator 10: best-fit-decreasing packing of tokenised documents into sequences.

Only lengths matter to best fit, and there are at most ``capacity`` of them. So the packing is
planned on the length histogram: lengths descend, and a segment tree over remaining capacities
finds the tightest open bin in logarithmic time. Bins of equal remainder are handled together: as
the tightest bin stays the tightest until the length no longer fits, k such bins take q = r // L
pieces each, in one step. The plan is a short list of runs (length, ranks -> sequences, offsets),
whose size follows the capacity, not the data. Pieces get their rank within their length by a
two-level distributed count and look their place up in the runs.

Tokenising: texts are cut into chunks at places where the tokenizer's own pattern always cuts and
where what follows cannot change what precedes; equal chunks are encoded once per worker and batch.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm import textkernel as tk
from brindle.llm.common import materialize, read_table

EOS = 2
CACHE = 48 << 20  # bytes of chunks that a worker remembers
JOINED = 2048  # bytes of chunks that are encoded as one text
RANKED = 1 << 10  # pieces of one length, about, that are ranked in one task
MAX_RUNS = 1_000_000  # a longer plan is joined without a broadcast

_SOLID = np.zeros(256, bool)  # bytes that begin a character which is no white space
_SOLID[0x21:0x7F] = _SOLID[0xC3:0xE0] = _SOLID[0xE4:0xF5] = True
_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,|*$%&#!?;:()")] = True
SPECIAL = b"<|endoftext|>"


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places where chunks begin, of texts joined at ``offsets``.

    With a byte-level BPE pattern (contractions, `` ?letters``, `` ?digits``, `` ?others``, white
    space before white space or the end, white space) these are always token borders: a space
    before a character that is none; a lone line feed between two printable ASCII characters, on
    both sides; an ASCII letter followed by a mark. A text with the special token's string is one chunk.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        spaced = (data[:-1] == 0x20) & _SOLID[data[1:]]
        ends = offsets[1:] - 1
        spaced[ends[(ends >= 0) & (ends < n - 1)]] = False  # the next byte is another text's
        cut[: n - 1] |= spaced
        cut[1:n] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        lone = np.flatnonzero((data[1:-1] == 0x0A) & _ASCII[data[:-2]] & _ASCII[data[2:]]) + 1
        cut[lone] = cut[lone + 1] = True
    cut[offsets] = True
    if SPECIAL in (raw := data.tobytes()):
        at = raw.find(SPECIAL)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            cut[offsets[row] + 1 : offsets[row + 1]] = False
            at = raw.find(SPECIAL, int(offsets[row + 1]))
    return np.flatnonzero(cut[:n])


class Encoder:
    """Token ids of texts by a tokenizer file, each distinct chunk encoded once.

    What is remembered are flat arrays (a chunk's hash, place and number of ids, and the ids), of
    ``most`` bytes at the utmost.
    """

    def __init__(self, path: str, most: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        words = self.tokenizer.get_vocab()  # a character stands for a byte
        self.bytes_of = np.zeros(max(words.values()) + 1, np.int64)
        self.bytes_of[np.fromiter(words.values(), np.int64, len(words))] = np.fromiter(map(len, words), np.int64, len(words))
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)  # by key
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode the chunks of unknown, ascending ``keys`` and merge them into what is known.

        A chunk of a space and what is none is a token border wherever it follows, so such chunks go
        to the tokenizer many at once; the bytes of the ids tell where each ends.
        """
        raw = data.tobytes()
        joined = (ends - starts > 1) & (data[starts] == 0x20) & _SOLID[data[np.minimum(starts + 1, len(data) - 1)]]
        joined &= SPECIAL not in raw
        order = np.argsort(~joined, kind="stable")
        pieces = [raw[a:b] for a, b in zip(starts[order].tolist(), ends[order].tolist(), strict=True)]
        n = int(joined.sum())
        total = np.cumsum((ends - starts)[order[:n]])
        groups = np.flatnonzero(np.diff(total // JOINED, prepend=-1)).tolist()
        texts = [b"".join(pieces[i:j]).decode() for i, j in zip(groups, [*groups, n][1:], strict=True)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([*texts, *(x.decode() for x in pieces[n:])], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, sum(map(len, ids)))
        alone = np.fromiter(map(len, ids[len(groups) :]), np.int64, len(pieces) - n)
        until = np.cumsum(self.bytes_of[flat[: len(flat) - int(alone.sum())]])
        last = np.searchsorted(until, total, "right")
        if n and not (until[last - 1] == total).all():
            raise ValueError("the tokenizer does not cut at spaces")
        size = np.empty(len(keys), np.int64)
        size[order] = np.concatenate([np.diff(last, prepend=0), alone])
        first = np.empty(len(keys), np.int64)
        first[order] = self.used + np.cumsum(size[order]) - size[order]
        if self.used + len(flat) > len(self.flat):
            grown = np.empty(2 * (self.used + len(flat)), np.uint32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.size = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.size, at, size)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each followed by EOS, and where each text's ids begin (one more at the end)."""
        starts = cuts(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        keys = tk.word_hashes(data, starts, ends)
        order = np.argsort(keys)
        sorted_ = keys[order]
        head = np.ones(len(sorted_), bool)
        np.not_equal(sorted_[1:], sorted_[:-1], out=head[1:])
        some, where = sorted_[head], order[head]
        at = np.searchsorted(self.keys, some)
        new = np.ones(len(some), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != some[inside]
        if new.any():
            self._learn(some[new], data, starts[where[new]], ends[where[new]])
            at = np.searchsorted(self.keys, some)
        index = np.empty(len(keys), np.int64)
        index[order] = at[np.cumsum(head) - 1] if len(order) else at
        first, sizes = self.first[index], self.size[index].astype(np.int64)
        row = np.searchsorted(offsets, starts, "right") - 1
        count = np.bincount(row, sizes, len(offsets) - 1).astype(np.int64) + 1
        begin = np.concatenate([[0], np.cumsum(count)])
        out = np.full(begin[-1], EOS, np.uint32)
        place = np.cumsum(sizes) - sizes
        step = np.arange(int(sizes.sum()))
        out[step + np.repeat(row, sizes)] = self.flat[step + np.repeat(first - place, sizes)]
        if 20 * len(self.keys) + 4 * len(self.flat) > self.most:
            self.clear()
        return out, begin


_encoders: dict[str, Encoder] = {}


def _tokenize(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for row, data, offsets in tk.slices(batch.column("text")):
                ids, begin = encoder.encode(data, offsets)
                rows = []
                for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                    head = (b - a) % capacity or capacity
                    piece, s, e = 0, a, min(b, a + head)
                    while s < b:
                        own = ids[s:e].astype("<u4").tobytes()
                        rows.append((doc_ids[row + i], piece, s - a, e - s, zlib.crc32(own), own if with_ids else None))
                        piece, s, e = piece + 1, e, e + capacity
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch({n: pa.array([r[j] for r in rows], k) for j, (n, k) in enumerate(zip(names, kinds, strict=True)) if with_ids or n != "ids"})

    return run


class SegmentTree:
    """Which of the values 0..n-1 are present; the least one at or above a bound, in logarithmic time."""

    def __init__(self, n: int) -> None:
        self.size = 1 << max(1, (n - 1).bit_length())
        self.node = [False] * (2 * self.size)

    def put(self, value: int, there: bool) -> None:
        i = value + self.size
        self.node[i] = there
        while i > 1:
            i //= 2
            self.node[i] = self.node[2 * i] or self.node[2 * i + 1]

    def least_from(self, bound: int) -> int | None:
        i = bound + self.size
        if i >= 2 * self.size:
            return None
        if self.node[i]:
            return bound
        while i > 1:
            if i % 2 == 0 and self.node[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.node[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan_packing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, ranks, first sequence, pieces a sequence, offset) and the number of sequences.

    The same packing as best-fit decreasing, piece by piece: rank r of a run stands in sequence
    ``first + (r - first rank) // q`` at ``offset + (r - first rank) % q * length``.
    """
    tree, bins, runs, opened = SegmentTree(capacity + 1), {}, [], 0

    def put(rest: int, first: int, n: int) -> None:
        if n and rest:
            if not bins.get(rest):
                bins[rest] = []
                tree.put(rest, True)
            bins[rest].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            rest = tree.least_from(length)
            if rest is None:
                rest, n, first = capacity, -(-left // (capacity // length)), opened
                opened += n
            else:
                first, n = bins[rest].pop()
                if not bins[rest]:
                    tree.put(rest, False)
            q = rest // length
            full = min(n, left // q)
            if full:
                runs.append((length, rank, full * q, first, q, capacity - rest))
                put(rest - q * length, first, full)
            rank, left, first, n = rank + full * q, left - full * q, first + full, n - full
            if n and left:  # left < q: one bin takes them all
                runs.append((length, rank, left, first, q, capacity - rest))
                put(rest - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(rest, first, n)
    return runs, opened


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian uint32).

    A document is the ids of its text (null: empty) and then EOS, so every row gives a piece. Only
    documents of more than ``capacity`` ids are cut, into pieces of ``capacity``; the first may be
    shorter. Rows that repeat an id are documents of their own; a null id stays null. Other
    columns are ignored. ``tokenizer``: path of a byte-level BPE file on every worker.
    """
    path = tokenizer or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    cut = materialize(rows.mapInArrow(_tokenize(path, capacity, with_ids), schema), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    parts = docs.sparkSession.createDataFrame([(k, -(-n // RANKED)) for k, n in histogram.items()], "length long, parts long")
    cut = cut.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "parts")).drop("parts")
    sums = cut.groupBy("length", "part").agg(F.count("*").alias("n"))  # a row for each RANKED pieces, and one a length
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = materialize(sums.drop("n"), "bases")
    runs, _ = plan_packing(histogram, capacity)
    plan = docs.sparkSession.createDataFrame(runs, "length long, first_rank long, ranks long, first long, q long, at long")
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = cut.withColumn("own", F.row_number().over(order)).join(sums, ["length", "part"]).withColumn("rank", F.col("base") + F.col("own") - 1)
    inside = (F.col("c.length") == F.col("p.length")) & (F.col("c.rank") >= F.col("p.first_rank")) & (F.col("c.rank") < F.col("p.first_rank") + F.col("p.ranks"))
    j = F.col("c.rank") - F.col("p.first_rank")
    out = ranked.alias("c").join((F.broadcast(plan) if len(runs) <= MAX_RUNS else plan).alias("p"), inside)
    return out.select(
        "c.doc_id", "c.piece", "c.start", "c.length", "c.ids_crc32", (F.col("p.first") + F.floor(j / F.col("p.q"))).alias("sequence_id"),
        (F.col("p.at") + F.pmod(j, F.col("p.q")) * F.col("c.length")).alias("offset"), *(["c.ids"] if with_ids else []),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
