"""Operator 8: secret scan by an incremental blob ledger.

Every text is a blob under its SHA-256 address; a path (document id, or any version of it) only
names a blob. The ledger records which rule at which version has read which blob. A scan takes the
distinct blobs, leaves out the (blob, rule, version) triples that the ledger knows, runs the rest,
and joins old and new findings back to all paths. Built-in functions only.

Addresses are planned first, without texts: one path of each blob that a rule has yet to read is
chosen. Rows whose path alone shows that their blob is new and nowhere else are then read in place;
texts are shuffled only of copies and of blobs that the ledger knows in part.

Places of matches come from two built-ins that walk a text alike: the pieces between matches and
the matches themselves; the running sum of their lengths gives every start.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import load_tables, materialize, read_table, rows_with_ids, rows_without_ids, save_tables


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; those whose ``group`` is shorter than ``least`` fall away.

    A text without a match of ``gate`` has no match of ``pattern`` that stays.
    """

    kind: str
    pattern: str
    gate: str
    group: int = 0
    least: int = 1
    version: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

#: Rules 1 to 3 are the base. A run of the exact class that is long enough is found by its length
#: alone, so ``access`` and ``hex`` state it in the pattern.
RULES = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", rf"({_NAMES})[\"']?\x20*[:=]", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", "AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}", "[0-9a-f]{24}"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}", "gh[opsur]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8,}\."),
)
BASE = 3


def _matches(rule: Rule) -> Column:
    """array<struct<kind, gap, size, ok>> of a blob's matches, empty where the gate is shut."""
    whole = F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)), lambda m: F.length(m))
    gaps = F.transform(F.split("text", rule.pattern, -1), lambda g: F.length(g))
    judged = F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)), lambda m: F.length(m) >= rule.least) if rule.group else F.transform(whole, lambda m: m >= rule.least)
    rows = F.transform(F.arrays_zip(whole.alias("m"), judged.alias("ok"), F.slice(gaps, 1, F.size(whole)).alias("g")), lambda x: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), x.g.alias("gap"), x.m.alias("size"), x.ok.alias("ok")))
    none = F.array().cast("array<struct<kind:string,version:int,gap:int,size:int,ok:boolean>>")
    return F.when(F.col("text").rlike(rule.gate) & F.array_contains("todo", f"{rule.kind}/{rule.version}"), rows).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, findings: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, ledger, findings) after reading ``docs`` (doc_id, text; null text is empty).

    paths: doc_id, blob, one row per input row (ids may repeat or be null). ledger: blob, done
    (array of ``kind/version``), old entries included. findings: blob, kind, version, start, end
    (code points, end exclusive), for old and new blobs. Pass the last two of one call to the next;
    texts are read again only by rules whose version the ledger lacks.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("blob", F.unhex(F.sha2("text", 256)))
    paths = materialize(texts.select("doc_id", "blob"), "paths")
    every = F.array(*(F.lit(f"{r.kind}/{r.version}") for r in rules))
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    none = F.array().cast("array<string>")
    if ledger is None:
        blobs = blobs.withColumn("done", none)
    else:
        blobs = blobs.join(ledger.select("blob", "done"), "blob", "left").withColumn("done", F.coalesce("done", none))
    blobs = materialize(blobs.withColumn("todo", F.array_except(every, "done")).withColumn("plain", (F.col("n") == 1) & (F.size("done") == 0)), "blobs")
    need = blobs.where(F.size("todo") > 0).select("blob", "doc_id", "todo")
    odd = materialize(paths.join(blobs.where("not plain").select("blob"), "blob", "left_semi").select("doc_id"), "odd")
    texts = rows_with_ids(texts, need)
    alone = rows_without_ids(texts, odd).withColumn("todo", every).select("blob", "text", "todo")
    same = (F.col("t.blob") == F.col("n.blob")) & F.col("t.doc_id").eqNullSafe(F.col("n.doc_id"))
    chosen = rows_with_ids(texts, odd).alias("t").join(need.alias("n"), same).select("t.blob", "t.text", "n.todo").dropDuplicates(["blob"])
    blobs = alone.unionByName(chosen)
    found = F.concat(*(_matches(r) for r in rules))
    scanned = materialize(blobs.select("blob", "todo", found.alias("found")), "scanned")

    place = Window.partitionBy("blob", "m.kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = scanned.where(F.size("found") > 0).select("blob", F.posexplode("found").alias("at", "m"))
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.size")).over(place)
    new = rows.withColumn("end", end).where("m.ok").select("blob", F.col("m.kind").alias("kind"), F.col("m.version").alias("version"), (F.col("end") - F.col("m.size")).alias("start"), "end")
    done = need.select("blob", F.col("todo").alias("done"))
    if ledger is not None:
        done = ledger.select("blob", "done").unionByName(done).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("done"))).alias("done"))
    if findings is not None:
        new = findings.select("blob", "kind", "version", "start", "end").unionByName(new)
    return paths, done, new


def save(ledger: DataFrame, findings: DataFrame, folder: str) -> str:
    """Write ledger and findings as the next version in ``folder``, for a later session."""
    return save_tables({"ledger": ledger, "findings": findings}, folder)


def load(spark: SparkSession, folder: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(ledger, findings) as last saved in ``folder``; two times None where nothing was."""
    tables = load_tables(spark, folder)
    return tables.get("ledger"), tables.get("findings")


def report(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = BASE) -> DataFrame:
    """One row per path: doc_id, n_<base kind>..., base_sha256, spans; findings of older rule versions are left out."""
    rank = {r.kind: i for i, r in enumerate(rules)}
    kinds = F.create_map(*(x for k, i in rank.items() for x in (F.lit(k), F.lit(i))))
    current = reduce(lambda a, b: a | b, ((F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules))
    span = F.struct("start", kinds[F.col("kind")].alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("said"))
    blobs = findings.where(current).distinct().groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("all"))
    of_base = F.filter("all", lambda x: x["rank"] < base)
    of_kind = lambda i: F.filter("all", lambda x: x["rank"] == i)
    joined = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: x.said))
    blobs = blobs.select("blob", *(F.size(of_kind(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])), joined(of_base).alias("base"), joined(F.col("all")).alias("spans"))
    out = paths.join(blobs, "blob", "left")
    return out.select("doc_id", *(F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in rules[:base]), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table in two batches of versions by ascending id: the ledger of the first spares the second what is known."""
    docs = read_table(spark, sf_dir, "documents")
    cut = docs.select(F.percentile_approx("doc_id", 0.5).alias("c")).first()["c"]
    old = F.coalesce(F.col("doc_id") <= F.lit(cut), F.lit(False))
    paths, ledger, findings = scan(docs.where(old))
    ledger, findings = materialize(ledger, "ledger"), materialize(findings, "findings")
    more, _, findings = scan(docs.where(~old), ledger=ledger, findings=findings)
    return report(paths.unionByName(more), findings)


def _sql() -> str:
    ctes, all_ = [], []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        ctes.append(f"""
r{i} AS (
  SELECT doc_id, generate_subscripts(m, 1) AS i, unnest(m) AS m, unnest(g) AS v, unnest(string_split_regex(text, '{p}')[:len(m)]) AS gap
  FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {r.group}) AS g FROM t) WHERE len(m) > 0
), f{i} AS (
  SELECT doc_id, {i} AS kind, e - length(m) AS s, '{r.kind}:' || (e - length(m)) || ':' || e AS said
  FROM (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM r{i}) WHERE length(v) >= {r.least}
)""")
        all_.append(f"SELECT * FROM f{i}")
    counts = ", ".join(f"coalesce(n{i}, 0) AS n_{r.kind}" for i, r in enumerate(RULES[:BASE]))
    sums = ", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n{i}" for i in range(BASE))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),{','.join(ctes)},
f AS ({' UNION ALL '.join(all_)}),
g AS (
  SELECT doc_id, {sums}, string_agg(said, ',' ORDER BY s, kind) FILTER (WHERE kind < {BASE}) AS base, string_agg(said, ',' ORDER BY s, kind) AS spans
  FROM f GROUP BY doc_id
)
SELECT t.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)
"""


ORACLE = _sql()
