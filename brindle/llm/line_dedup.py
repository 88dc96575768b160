"""Operator 9: line deduplication by a suffix array over line ids.

Every document is its sequence of lines that hold a word; a line's id is 128 bits of its SHA-256.
The array orders all suffixes that begin with a line which some other suffix begins with too.

Documents of equal text are one sequence there: all but the first repeat it.

Prefix doubling: a suffix's rank is the place where its bucket, the suffixes that share its first h
lines, begins in the array. Tuples (rank, rank h lines on) are counted, sorted by range, and summed up
in two levels, which gives the ranks for 2h lines; a hot bucket is a few counted tuples. Suffixes
alone in their bucket, or whose next block stands nowhere else or is settled, have their place and leave.

Longest common prefixes: neighbouring tuples that a round tells apart share h lines and fewer than 2h.
What they share beyond h is found by going down the ranks of h/2, h/4, .. 1 lines.

The array is cut where neighbours share fewer than ``min_lines`` lines. What is left between cuts are
the LCP intervals; each is one run that repeats. Its first copy (smallest id, then place) stays, the
lines of all later copies go. A run longer than the interval's is the union of those of its suffixes,
so maximal runs go whole. With ``long_words``, cuts at fewer lines are made too, and intervals whose
shared lines hold more words than that are runs as well.

Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import WORD, materialize, read_table, rows_with_ids, rows_without_ids

HAS_WORD = r"[^\x20\x09-\x0D]"
KEY = ["id", "print"]
NONE = -1  # rank of a block that stands nowhere else


def _place(prefix: str = "") -> Column:
    """Reading order of suffixes: by id (nulls last), then text, then line."""
    return F.struct(F.col(f"{prefix}id").isNull().alias("last"), *(F.col(f"{prefix}{c}").alias(c) for c in (*KEY, "at")))


def _same(a: str, b: str, at: Column) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.print") == F.col(f"{b}.print")) & (at == F.col(f"{b}.at"))


def _running(rows: DataFrame, by: list[str], name: str, **totals: tuple[Callable, Column]) -> DataFrame:
    """``rows`` sorted by ``by``, each with the totals (F.sum, or F.max of what ascends) of all rows before it.

    A range-partitioned sort, a sum for each partition, and a window in each: no task holds all.
    """
    rows = materialize(rows.orderBy(*by).withColumn("place", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("part", F.shiftright("place", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(*(f(c).alias(k) for k, (f, c) in totals.items()))  # a row a partition
    parts = parts.select("part", *(f(k).over(before).alias(f"{k}_base") for k, (f, _) in totals.items()))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(parts), "part")
    none = F.lit(0).cast("long")
    both = lambda k, f, own: F.coalesce(own, none) + F.coalesce(f"{k}_base", none) if f is F.sum else F.coalesce(own, f"{k}_base")
    return rows.withColumns({k: both(k, f, f(c).over(inside)) for k, (f, c) in totals.items()}).drop("part", *(f"{k}_base" for k in totals))


def _found_at(rows: DataFrame, wanted: DataFrame, at: Column) -> DataFrame:
    """The ``rows`` (id, print, at, ..) that may stand at the places ``at`` of ``wanted``: these alone go into the join that follows."""
    key = F.xxhash64(*KEY, "at").alias("__key")
    some = wanted.select(*KEY, at.alias("at")).select(key)
    return rows_with_ids(rows.select("*", key), some, "__key").drop("__key")


def suffix_array(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(suffixes, buckets, shared) of ``lines`` (id, print, at, line, ..), lines that stand only once left out.

    suffixes: id, print, at, rank; ``rank`` orders them. buckets: rank, lcp (lines shared with the
    bucket before), inner (lines that its suffixes share; null for a bucket of one). shared: the lines
    that stand twice or more, with all columns but ``line``.
    """
    shared = materialize(lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1"), "shared-lines")
    ranks = materialize(_running(shared, ["line"], "lines-in-order", rank=(F.sum, F.col("n"))).select("line", "rank"), "line-ranks")
    # Repeated rows are one document: a line of theirs counts once.
    first = materialize(rows_with_ids(lines, shared, "line").join(ranks, "line").drop("line").dropDuplicates([*KEY, "at"]), "suffixes-1")
    # The depth goes along as a column: rounds then differ in nothing that is compiled.
    active = first.select(*KEY, "at", "rank", F.lit(1).alias("depth"))
    levels, done, bounds, h, rows = {1: active}, [], {}, 1, {}
    while n := active.count():
        rows[h] = n
        every = active.select(*KEY, "at", "rank", F.lit(None).cast("int").alias("inner"))
        for d in done:
            every = every.unionByName(d)
        every = _found_at(every, active, F.col("at") + F.col("depth"))
        pairs = active.alias("a").join(every.alias("b"), _same("a", "b", F.col("a.at") + F.col("a.depth")), "left")
        # ``more``: lines, and no others, that suffixes which have ``next`` in common share there; null while that is open.
        more = F.when(F.col("b.rank").isNull(), 0).otherwise(F.col("b.inner")).alias("more")
        pairs = materialize(pairs.select("a.*", F.coalesce("b.rank", F.lit(NONE).cast("long")).alias("next"), more), f"pairs-{h}", n)
        tuples = pairs.groupBy("rank", "next").agg(F.count("*").alias("n"), F.min(_place()).alias("rep"), F.max("depth").alias("depth"))
        tuples = _running(tuples, ["rank", "next"], f"tuples-{h}", before=(F.sum, F.col("n")), prev=(F.max, F.struct("place", "rank", "next", "rep")))
        tuples = materialize(tuples, f"tuples-in-order-{h}", n)
        base = materialize(tuples.groupBy("rank").agg(F.min("before").alias("base")), f"buckets-{h}", n)
        tuples = materialize(tuples.join(base, "rank").withColumn("new", F.col("rank") + F.col("before") - F.col("base")), f"ranks-{h}", n)
        open_ = (F.col("next") != NONE) & (F.col("prev.next") != NONE) & (F.col("depth") > 1)
        bounds[h] = tuples.where("prev.rank = rank").select(F.col("new").alias("rank"), F.col("rep").alias("s"), F.col("prev.rep").alias("t"), F.col("depth").alias("lcp"), open_.alias("open"))
        ranked = pairs.join(tuples.select("rank", "next", "n", "new"), ["rank", "next"]).select(*KEY, "at", F.col("new").alias("rank"), "n", "more", "depth")
        ranked = materialize(ranked, f"suffixes-{2 * h}", n)
        settled = (F.col("n") == 1) | F.col("more").isNotNull()
        done.append(ranked.where(settled).select(*KEY, "at", "rank", F.when(F.col("n") > 1, F.col("more") + F.col("depth")).alias("inner")))
        active = ranked.where(~settled).select(*KEY, "at", "rank", (F.col("depth") * 2).alias("depth"))
        h *= 2
        levels[h] = active
    suffixes = active.select(*KEY, "at", "rank", F.lit(None).cast("int").alias("inner"))
    for d in done:
        suffixes = suffixes.unionByName(d)
    lcp = _lcp(bounds, levels, rows, shared.sparkSession)
    buckets = suffixes.groupBy("rank").agg(F.max("inner").alias("inner")).join(lcp, "rank", "left")
    return suffixes, buckets.select("rank", F.coalesce("lcp", F.lit(0)).alias("lcp"), "inner"), first


def _lcp(bounds: dict[int, DataFrame], levels: dict[int, DataFrame], rows: dict[int, int], spark: SparkSession) -> DataFrame:
    """(rank, lcp) of the buckets that follow one with which they share a line or more; ``rows`` suffixes were open at each depth."""
    out = spark.createDataFrame([], "rank long, lcp int")
    for b in bounds.values():
        out = out.unionByName(b.where("not open").select("rank", "lcp"))
    open_ = None
    for g in sorted((h // 2 for h in bounds if h > 1), reverse=True):
        more = bounds[2 * g].where("open").drop("open")
        open_ = more if open_ is None else open_.unionByName(more)
        at = levels[g]
        both = open_.alias("o").join(at.alias("a"), _same("o.s", "a", F.col("o.s.at") + F.col("lcp")), "left").join(at.alias("b"), _same("o.t", "b", F.col("o.t.at") + F.col("lcp")), "left")
        open_ = materialize(both.select("o.rank", "s", "t", F.when(F.col("a.rank") == F.col("b.rank"), F.col("lcp") + F.col("a.depth")).otherwise(F.col("lcp")).alias("lcp")), f"lcp-{g}", sum(n for h, n in rows.items() if h > g))
    return out if open_ is None else out.unionByName(open_.select("rank", "lcp"))


def repeated_runs(lines: DataFrame, min_lines: int, long_words: int | None = None) -> DataFrame:
    """(id, print, at, depth) where later copies of repeated runs begin, of ``lines`` (id, print, at, line, words)."""
    suffixes, buckets, shared = suffix_array(lines)
    depths = [min_lines] if long_words is None else list(range(1, min_lines + 1))
    cut = lambda m: F.when(F.col("lcp") < m, F.col("rank"))
    heads = _running(buckets, ["rank"], "array", **{f"head_{m}": (F.max, cut(m)) for m in depths})
    heads = materialize(heads.select("rank", *(F.coalesce(cut(m), f"head_{m}").alias(f"head_{m}") for m in depths)), "heads")
    array = materialize(suffixes.join(heads, "rank"), "suffix-array")
    starts, words = None, None
    if min_lines > 1 and long_words is not None:
        # Words of the first m lines: where a run has m lines, all are among the shared.
        ahead = lambda m: Window.partitionBy(*KEY).orderBy("at").rangeBetween(0, m - 1)
        words = shared.select(*KEY, "at", *(F.sum("words").over(ahead(m)).alias(f"words_{m}") for m in depths[:-1]))
        words = materialize(words.where(F.col(f"words_{min_lines - 1}") > long_words), "long-lines")
    for m in depths:
        rows = array.where(F.coalesce(F.col("inner") >= m, F.lit(True))).select(*KEY, "at", F.col(f"head_{m}").alias("head"))
        if m < min_lines:
            long_ = words.where(F.col(f"words_{m}") > long_words).select(*KEY, "at")
            rows = _found_at(rows, long_, F.col("at"))
            rows = materialize(rows.alias("r").join(long_.alias("l"), _same("r", "l", F.col("r.at")), "left_semi"), f"long-{m}")
        first = materialize(rows.groupBy("head").agg(F.min(_place()).alias("first")), "first-copies")
        later = rows.join(first, "head").where(_place() != F.col("first")).select(*KEY, "at", F.lit(m).alias("depth"))
        starts = later if starts is None else starts.unionByName(later)
    return starts


def line_dedup(docs: DataFrame, min_lines: int = 3, id_col: str = "doc_id", text_col: str = "text", stats: bool = False, long_words: int | None = None) -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from the text.

    Lines end at ``\\n`` and are equal when identical; lines without a word neither join nor part a
    run and are never deleted. A run has ``min_lines`` lines or more, or, where ``long_words`` is
    given, fewer lines of more than so many words together; it may repeat within one document or
    overlap itself. Order is by id (nulls last), then by the text's hash, then by
    place. Rows that repeat both id and text are one document: all of them are cut alike. A null
    text stays null. All columns are kept, whatever their names; with ``stats`` the result is
    (row, text, n_lines, n_removed, n_runs) with the whole input row as a struct, counts of lines
    with words, and runs of deleted neighbours. No rows: no rows.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row = row.select("row", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").cast("string").alias("text"))
    row = row.withColumn("print", F.xxhash64("text"))
    # One pass over the texts: from here on a document is its text's address and its lines' ids and sizes.
    own = lambda x: F.struct(F.unhex(F.substring(F.sha2(x, 256), 1, 32)).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"))
    seqs = row.where("text is not null").select(*KEY, F.unhex(F.sha2("text", 256)).alias("same"), F.filter(F.transform(F.split("text", "\n", -1), own), lambda x: x.words > 0).alias("lines"))
    seqs = materialize(seqs.where(F.size("lines") > 0), "sequences")
    order = F.struct(F.col("id").isNull().alias("last"), *KEY)
    groups = materialize(seqs.groupBy("same").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").drop("n"), "copies")
    # Of equal texts the first is in the array for all; the others repeat it whole, if it is a run.
    held = rows_with_ids(seqs, groups, "same").join(groups, "same", "left")
    again = F.col("first").isNotNull() & (order != F.col("first"))
    whole = F.size("lines") >= min_lines
    if long_words is not None:
        whole |= F.aggregate("lines", F.lit(0), lambda a, x: a + x.words) > long_words
    copies = held.where(again & whole).select(*KEY, F.posexplode("lines").alias("at", "line")).select(*KEY, "at")
    alone = rows_without_ids(seqs, groups, "same").unionByName(held.where(~again).select(*seqs.columns))
    lines = alone.select(*KEY, F.posexplode("lines").alias("at", "l")).select(*KEY, "at", "l.line", F.col("l.words").cast("long").alias("words"))
    starts = repeated_runs(lines, min_lines, long_words)
    gone = starts.select(*KEY, F.explode(F.sequence("at", F.col("at") + F.col("depth") - 1)).alias("at")).unionByName(copies).distinct()
    gone = materialize(gone.groupBy(*KEY).agg(F.sort_array(F.collect_list("at")).alias("gone")), "gone")

    cut = rows_with_ids(row, gone, "id").alias("r").join(gone.hint("merge").alias("g"), F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.print") == F.col("g.print")), "left").select("row", "text", "gone")
    whole = rows_without_ids(row, gone, "id").select("row", "text", F.lit(None).cast("array<int>").alias("gone"))
    done = cut.unionByName(whole)
    done = done.withColumn("lines", F.split("text", "\n", -1))
    done = done.withColumn("worded", F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(HAS_WORD), i)), lambda i: i.isNotNull()))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.transform("gone", lambda g: F.get("worded", g)))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    done = done.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept))
    if stats:
        runs = F.size(F.filter("gone", lambda g, i: (i == 0) | (F.get("gone", i - 1) != g - 1)))
        count = lambda c: F.when(c >= 0, c).otherwise(0).cast("long")  # noqa: E731  the size of null is -1 or null
        return done.select("row", "text", count(F.size("worded")).alias("n_lines"), count(F.size("gone")).alias("n_removed"), count(runs).alias("n_runs"))
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, n_runs, kept_sha256 (of the text left, null as empty).

    Runs of three lines or more, and shorter ones of more than fifty words.
    """
    out = line_dedup(read_table(spark, sf_dir, "documents"), stats=True, long_words=50)
    return out.select("row.doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Maximal runs as islands on the diagonals of all pairs of equal lines.
ORACLE = """
WITH raw AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), marked AS (
  SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded FROM raw
), seq AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM marked WHERE worded
), pairs AS (
  SELECT b.doc_id, b.pos, b.words, a.doc_id AS of_id, b.pos - a.pos AS diagonal
  FROM seq a JOIN seq b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.pos < b.pos))
), islands AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id, of_id, diagonal ORDER BY pos) AS island FROM pairs
), maximal AS (
  SELECT doc_id, min(pos) AS low, max(pos) AS high FROM islands GROUP BY doc_id, of_id, diagonal, island HAVING count(*) >= 3 OR sum(words) > 50
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(low, high)) AS pos FROM (SELECT DISTINCT * FROM maximal)
), runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE p IS NULL OR p <> pos - 1) AS n_runs
  FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM gone) GROUP BY doc_id
), kept AS (
  SELECT m.doc_id, string_agg(m.line, chr(10) ORDER BY m.i) AS text
  FROM marked m LEFT JOIN seq s ON s.doc_id = m.doc_id AND s.i = m.i LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.pos = s.pos
  WHERE g.pos IS NULL GROUP BY m.doc_id
), counts AS (
  SELECT doc_id, count(*) AS n_lines FROM seq GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
