import math

import numpy as np
import pytest
from brute import components, multiset, near, shingles, substrings

from brindle.llm import embedding_itq, ngram_join, substring_dedup
from brindle.llm import textkernel as tk


@pytest.mark.parametrize("k,t,num,den", [(3, "0.9", 9, 10), (5, "0.8", 4, 5), (1, "0.5", 1, 2)])
def test_ngram_join(docs, plain, k, t, num, den):
    got = ngram_join.ngram_jaccard_join(docs, k, t, sketch_bits=12)
    assert multiset(got.collect()) == multiset(near(plain, k, num, den))


def test_ngram_join_blocks(docs, plain, monkeypatch):
    """Posting lists cut into blocks of three rows, none but pairs light, hubs with two partners a task."""
    monkeypatch.setattr(ngram_join, "LIGHT", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    monkeypatch.setattr(ngram_join, "PARTNERS", 2)
    monkeypatch.setattr(ngram_join, "PIECES", 1)
    got = ngram_join.ngram_jaccard_join(docs, 1, "0.4", sketch_bits=12)
    assert multiset(got.collect()) == multiset(near(plain, 1, 2, 5))


@pytest.mark.parametrize("k,t,num,den,block", [(3, "0.9", 9, 10, 256), (1, "0.4", 2, 5, 3)])
def test_ngram_join_links(docs, plain, monkeypatch, k, t, num, den, block):
    """Every link counts, also inside a component that other links hold together, and in blocks."""
    monkeypatch.setattr(ngram_join, "LINK_BLOCK", block)
    monkeypatch.setattr(ngram_join, "COLUMNS", 50)
    sets = [shingles(text, k) for _, text in plain]
    degree = [sum(den * len(x & y) >= num * len(x | y) for y in sets) - 1 if x else 0 for x in sets]
    got = ngram_join.ngram_jaccard_join(docs, k, t, sketch_bits=12, links=True)
    assert multiset(got.collect()) == multiset([(*r, n) for r, n in zip(near(plain, k, num, den), degree, strict=True)])


def test_ngram_join_edges(empty, clashing, plain):
    assert ngram_join.ngram_jaccard_join(empty).count() == 0
    assert multiset(ngram_join.ngram_jaccard_join(clashing, 3, "0.9", sketch_bits=12).collect()) == multiset(near(plain, 3, 9, 10))


def test_substrings(docs, plain):
    assert multiset(substring_dedup.substring_dedup(docs, buckets=8).collect()) == multiset(substrings(plain, 13))


@pytest.mark.parametrize("width,gram,batches", [(6, 3, 1), (5, 2, 7), (13, 13, 3)])
def test_substring_index(docs, plain, width, gram, batches):
    """Many batches: runs are merged with and compacted."""
    index = substring_dedup.FingerprintIndex(4, width, gram, most_runs=2)
    got = substring_dedup.substring_dedup(docs, width, gram, batches, index=index)
    assert multiset(got.collect()) == multiset(substrings(plain, width))
    assert len(index.runs) <= 3


@pytest.mark.parametrize("width,gram,batches", [(13, 5, 2), (5, 2, 1)])
def test_substring_history(docs, plain, width, gram, batches):
    """Two calls with one index give what one call over both inputs gives."""
    index = substring_dedup.FingerprintIndex(4, width, gram)
    low = substring_dedup.substring_dedup(docs.where("doc_id < 40"), width, gram, batches, index=index)
    high = substring_dedup.substring_dedup(docs.where("doc_id is null or doc_id >= 40"), width, gram, batches, index=index)
    assert multiset(low.collect() + high.collect()) == multiset(substrings(plain, width))


def test_substring_saved_index(spark, docs, plain, tmp_path):
    """An index that is saved and loaded between calls, with compaction, serves as one that stays."""
    folder, out = str(tmp_path / "index"), []
    assert substring_dedup.FingerprintIndex.load(spark, folder) is None
    for part in ("doc_id < 30", "doc_id >= 30 and doc_id < 60", "doc_id is null or doc_id >= 60"):
        index = substring_dedup.FingerprintIndex.load(spark, folder) or substring_dedup.FingerprintIndex(4, 13, 5, most_runs=1)
        out += substring_dedup.substring_dedup(docs.where(part), batches=1, index=index).collect()
        index.save(folder)
    assert multiset(out) == multiset(substrings(plain, 13))
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(docs, width=6, index=index)


def test_substring_query(spark, docs, plain, tmp_path):
    """The query's batches, runs and compaction."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert multiset(substring_dedup.query(spark, str(tmp_path)).collect()) == multiset(substrings(plain, 13))


def test_substring_edges(empty, clashing, plain, docs):
    assert substring_dedup.substring_dedup(empty, buckets=4).count() == 0
    assert multiset(substring_dedup.substring_dedup(clashing, buckets=4).collect()) == multiset(substrings(plain, 13))
    kept = substring_dedup.substring_dedup(docs, buckets=4, with_text=True).where("n_removed = 0 and n_words = 1").collect()
    assert {r["text"] for r in kept} >= {"one"}


def test_word_hash_blocks(monkeypatch):
    """Blocks of text give the hashes that the whole gives."""
    data = np.frombuffer(("alpha beta gamma delta " * 50 + "w" * 300 + " tail").encode(), np.uint8)
    s, e, _ = tk.words(data, np.array([0, len(data)]))
    whole = tk.word_hashes(data, s, e)
    monkeypatch.setattr(tk, "BLOCK", 64)
    assert (tk.word_hashes(data, s, e) == whole).all()


def vectors(seed=1, n=400, d=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, 120, 3):
        x[i + 1] = x[i] + 0.1 * rng.normal(size=d)
        x[i + 2] = x[i]
    x[200:240] = x[200] + 0.15 * rng.normal(size=(40, d))
    return x.astype(np.float32)


@pytest.mark.parametrize("block", [1024, 5])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_itq, "BLOCK", block)
    x = vectors()
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [1.0, None] * 12), (904, [float("nan")] * 24), (905, [float("inf")] + [0.0] * 23), (906, [1.0, 2.0]), (None, [float(v) for v in x[0]])]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(i, v, 1) for i, v in odd]
    got = embedding_itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, links int")).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    u = np.vstack([u, u[:1]])  # the row without an id
    links = [(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.9, 1)), strict=True)]
    degree = np.bincount([i for p in links for i in p], minlength=len(u))
    found = {r["vec_id"]: r for r in got if r["vec_id"] is not None and r["vec_id"] < 900}
    assert sum(r["n_links"] for r in found.values()) + degree[-1] >= 0.97 * degree.sum()
    assert all(found[i]["n_links"] <= degree[i] for i in range(len(x)))
    part = components(len(u), links)
    assert np.mean([found[i]["component_id"] == part[i] for i in range(len(x))]) > 0.97
    assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"] for r in got if (r["vec_id"] or 0) >= 900)
    assert [(r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, False)]


def test_embeddings_empty(spark):
    assert embedding_itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def planted(rng, n, d, pairs):
    """Vectors of which ``pairs`` have a partner at a cosine from 0.9 to 0.97."""
    x = rng.normal(size=(n, d)) + 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.97, pairs)[:, None]
    off = rng.normal(size=(pairs, d))
    off -= (off * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    x[n - pairs :] = cos * x[:pairs] + np.sqrt(1 - cos**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    return x * rng.uniform(0.1, 10, (n, 1))


def test_embeddings_recall(spark, capsys):
    """Links of 12,500 planted vectors of three widths, against brute force."""
    rng = np.random.default_rng(3)
    parts = {d: planted(rng, n, d, n // 8) for d, n in ((32, 4000), (64, 6000), (160, 2500))}
    rows, at = [], {}
    for d, x in parts.items():
        at[d] = len(rows)
        rows += [(len(rows) + i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in embedding_itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    for d, x in parts.items():
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        degree = (u @ u.T >= 0.9).sum(1) - 1
        found = np.array([got[at[d] + i]["n_links"] for i in range(len(x))])
        assert (found <= degree).all()
        recall = found.sum() / degree.sum()
        with capsys.disabled():
            print(f"op6 recall, width {d}: {recall:.4f} of {degree.sum() // 2} links")
        assert recall >= 0.95


def test_embeddings_in_double(spark):
    """Numbers that single precision does not hold, and a cosine next to 0.9."""
    c = 0.9 + 1e-9
    rows = [(1, [1e300, 1e300]), (2, [1e300, 1e300]), (3, [1e-60, 0.0]), (4, [1e-60, 0.0]), (5, [0.0, 5.0]), (6, [c, math.sqrt(1 - c * c)])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 3), 4: (2, 3), 5: (0, 5), 6: (2, 3)} or got[1][0] >= 1 <= got[3][0]
    near = [(1, [1.0, 0.0]), (2, [0.9 - 1e-9, math.sqrt(1 - (0.9 - 1e-9) ** 2)]), (3, [c, -math.sqrt(1 - c * c)])]
    got = {r["vec_id"]: r["n_links"] for r in embedding_itq.near_duplicates(spark.createDataFrame(near, "vec_id long, embedding array<double>")).collect()}
    assert got[2] == 0 and got[1] == got[3] <= 1


def test_embeddings_of_many_widths(spark, monkeypatch):
    """Widths without codes of their own are compared in full."""
    monkeypatch.setattr(embedding_itq, "WIDTHS", 2)
    rng = np.random.default_rng(7)
    rows = []
    for d in range(2, 9):
        x = planted(rng, 24 + d, d, 6)
        rows += [(len(rows) + i, v.tolist(), d) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in embedding_itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int")).collect()}
    for d in range(2, 7):  # the two most frequent widths, 7 and 8, have codes
        own = [(i, np.array(v)) for i, v, e in rows if e == d]
        u = np.array([v / np.linalg.norm(v) for _, v in own])
        degree = (u @ u.T >= 0.9).sum(1) - 1
        assert [got[i] for i, _ in own] == degree.tolist()


@pytest.mark.parametrize("size,probe", [(8, 0), (8, 1), (16, 1)])
def test_pairs_meet_once(size, probe):
    """A pair within the radius meets in some bucket when a substring is near enough, and counts in one of them only."""
    rng = np.random.default_rng(size + probe)
    base = rng.integers(0, 1 << 63, (30, 2), dtype=np.uint64)
    words = np.vstack([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, base.shape, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, base.shape, dtype=np.uint64)) for _ in range(4)])
    index = embedding_itq.Index(np.zeros(1), np.zeros((1, 128)), size, probe, 10)
    held = index.buckets(words)
    seen = np.zeros((len(words), len(words)), int)
    for t in range(held.shape[1]):
        for b in np.unique(held[:, t]):
            i = np.flatnonzero((held[:, t] == b).any(1))
            seen[np.ix_(i, i)] += index.meets(words[i], words[i], t, b)
    keys = index.keys(words)
    near = (np.bitwise_count(keys[:, None] ^ keys[None]) <= 2 * probe).any(2) & (index.distance(words, words) <= 10)
    assert (seen == near).all()


def test_itq_balances_codes():
    x = vectors(5, 2000, 16).astype(float) + 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, project = embedding_itq.itq(x, 8)
    share = ((x - mean) @ project >= 0).mean(0)
    assert project.shape == (16, 8) and (np.abs(share - 0.5) < 0.2).all()
    assert embedding_itq.itq(x)[1].shape == (16, 128)
    assert {embedding_itq.fit(x, n, 0.9).size for n in (10**3, 10**12)} <= {8, 16, 32}
