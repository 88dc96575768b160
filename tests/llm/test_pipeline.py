"""Each stage against a plain version on what the stage before it kept."""

from collections import Counter

from brute import line_runs, near, words
from pyspark.sql import functions as F

import corpus_pipeline as p
from brindle.llm import quality_qda


def test_stages(spark, docs, tmp_path):
    """All rows, null ids and texts and repeated rows among them."""
    labels = docs.where("doc_id is not null").select("doc_id", F.when(F.length("text") > 20, 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic")).distinct()
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sf, now, kept = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet")), []
    assert [f for _, f in p.STAGES] == [p.quality, p.lines, p.near_copies, p.mix, p.sequences]
    for i, (_, stage) in enumerate(p.STAGES):
        stage(spark, now, sf).write.parquet(str(tmp_path / f"s{i}"))
        now = spark.read.parquet(str(tmp_path / f"s{i}"))
        kept.append([r.asDict() for r in now.collect()])
        assert now.columns == docs.columns or i == 4
    pairs = [Counter((r["doc_id"], r["text"]) for r in k) for k in kept[:4]]
    mark = {(r["doc_id"], r["key"]): r["predicted"] for r in quality_qda.classify(docs, labels).collect()}
    every = docs.withColumn("key", F.xxhash64("text")).collect()
    assert pairs[0] == Counter((r["doc_id"], r["text"]) for r in every if mark[r["doc_id"], r["key"]]) and 60 < sum(pairs[0].values()) < len(every)
    cut = line_runs([x for x in pairs[0] if x[1] is not None], 3, 50)
    left = Counter()
    for (d, was), n in pairs[0].items():
        t = cut.get((d, was))
        if was is None or words(t) or not words(was):
            left[d, t] += n
    assert pairs[1] == left and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept[1])
    plain = list(pairs[1].elements())
    groups = {}
    for i, n, c in near([(i, t) for i, (_, t) in enumerate(plain)], 5, 4, 5):
        groups.setdefault(c if n else -1 - i, []).append(plain[i])
    assert sum(pairs[2].values()) == len(groups) < len(plain) and not pairs[2] - pairs[1]
    for g in groups.values():
        least = min((d for d, _ in g if d is not None), default=None)
        assert any(pairs[2][x] for x in g if x[0] == least)
    of_id = {}
    for d, t in pairs[2]:
        of_id.setdefault(d, []).append(Counter(words(t)))
    for r in kept[3]:
        assert words(r["text"]) and any(not Counter(words(r["text"])) - own for own in of_id[r["doc_id"]])
    rows_of = Counter(d for d, _ in pairs[2].elements())
    assert all(n <= 3 * rows_of[d] for d, n in Counter(r["doc_id"] for r in kept[3]).items())
    assert {r["doc_id"] for r in kept[4]} == {r["doc_id"] for r in kept[3]}
    assert sum(r["piece"] == 0 for r in kept[4]) == len(kept[3])
    ran = p.run(spark, sf)
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in ran.collect()) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in kept[4])


def test_clashing_columns(spark, clashing, docs, tmp_path):
    """Columns named as the operators name theirs are carried along."""
    docs.where("doc_id is not null").select("doc_id", F.when(F.length("text") > 20, 1).otherwise(0).alias("quality")).distinct().write.parquet(str(tmp_path / "labels.parquet"))
    now, plain = clashing, docs
    for i, (_, stage) in enumerate(p.STAGES[:4]):
        now, plain = stage(spark, now, str(tmp_path)), stage(spark, plain, str(tmp_path))
        if i < 3:  # the mix orders documents by a hash of all columns
            assert now.columns == clashing.columns
            assert Counter((r["doc_id"], r["text"]) for r in now.collect()) == Counter((r["doc_id"], r["text"]) for r in plain.collect())
    assert now.columns == clashing.columns and now.count() > 0


def test_rows_apart(spark, docs, tmp_path):
    """Null and repeated ids: each row is judged by its own text, and one of each group of near copies stays."""
    labels = docs.where("doc_id is not null").select("doc_id", F.when(F.length("text") > 20, 1).otherwise(0).alias("quality")).distinct()
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    more = [(None, "one", "en", "src0", 3), (2, "one", "en", "src0", 3), (3, text[2], "en", "src0", 1), (70, text[2], "en", "src0", 1), (None, text[6] + " own end", "en", "src0", 1), (4, None, "en", "src0", 0)]
    rows = docs.unionByName(spark.createDataFrame(more, docs.schema))
    mark = {(r["doc_id"], r["key"]): r["predicted"] for r in quality_qda.classify(rows, labels).collect()}
    hashed = rows.withColumn("key", F.xxhash64("text")).collect()
    want = Counter((r["doc_id"], r["text"]) for r in hashed if mark[r["doc_id"], r["key"]])
    assert Counter((r["doc_id"], r["text"]) for r in p.quality(spark, rows, str(tmp_path)).collect()) == want and 0 < sum(want.values()) < len(hashed)
    plain = [(r["doc_id"], r["text"]) for r in hashed]
    groups = {}
    for i, n, c in near([(i, t) for i, (_, t) in enumerate(plain)], 5, 4, 5):
        groups.setdefault(c if n else -1 - i, []).append(plain[i])
    kept = Counter((r["doc_id"], r["text"]) for r in p.near_copies(spark, rows, "").collect())
    assert sum(kept.values()) == len(groups) < len(plain)
    for g in groups.values():
        least = min((d for d, _ in g if d is not None), default=None)
        assert sum(kept[x] > 0 for x in set(g)) == 1 and any(kept[x] for x in g if x[0] == least)


def test_empty(spark, docs, tmp_path):
    none = docs.limit(0)
    none.select("doc_id", F.lit(1).alias("quality")).write.parquet(str(tmp_path / "labels.parquet"))
    for i, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0, i
