"""Every operator applied to the test tables: ``QUERIES`` and, where SQL can say the same, ``ORACLES``.

Interactions come from order lines (``retail``) unless a name ends in ``_events``. Doubles are
rounded on both sides, as engines sum in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.columns import epoch_micros
from brindle.operators import churn, components, experiments, features, graph, interventions, metrics, ranking, reports, revenue, splits
from brindle.plans import oracles as q
from brindle.schema import INTERACTIONS, canonicalize, validation_counts
from brindle.scratch import materialize, shared_dir
from brindle.sources import io
from brindle.sources.adapters import clicks, retail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The test tables are small: thresholds that leave a graph on them.
GRAPH = graph.GraphConfig(min_support=20, min_cooc=2, min_cosine=0.05)
CLUSTERS = components.ClusterConfig(min_cosine=0.05, min_cooc=5, min_size=2)
POLICY = interventions.InterventionConfig(cap_discount=20, cap_content=400, cap_email=100)


def register(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c, t in df.dtypes if t in ("double", "float")})


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_per_user(retail(spark, sf_dir))


def train_val(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Train and val of labels that are written once: the queries read them several times."""
    train, val, _ = splits.splits(materialize(labeled(spark, sf_dir), "labeled"))
    return train, val


def shuffled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that ignore time, so that violations are found."""
    m = F.col("item_id") % 3
    return retail(spark, sf_dir).withColumn("split", F.when(m == 0, "train").when(m == 1, "val").otherwise("test"))


SHUFFLED = "labeled AS (SELECT *, CASE item_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM inter)"
SPANS = """spans AS (
  SELECT user_id, max(ts) FILTER (WHERE split = 'train') AS train_max, min(ts) FILTER (WHERE split = 'val') AS val_min, max(ts) FILTER (WHERE split = 'val') AS val_max, min(ts) FILTER (WHERE split = 'test') AS test_min
  FROM labeled GROUP BY user_id)"""
ALL = q.RETAIL, q.LABELED


@register(q.query("SELECT * FROM labeled", *ALL))
def split_per_user(spark, sf_dir):
    return labeled(spark, sf_dir)


GLOBAL = """placed AS (SELECT *, row_number() OVER (ORDER BY ts, user_id, item_id, rating) AS pos, count(*) OVER () AS n FROM inter), labeled AS (
  SELECT user_id, item_id, rating, ts, CASE WHEN pos <= greatest(1, CAST(floor(n * 0.7::DOUBLE) AS BIGINT)) THEN 'train'
    WHEN pos <= greatest(1, CAST(floor(n * 0.7::DOUBLE) AS BIGINT), CAST(floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) AS BIGINT)) THEN 'val' ELSE 'test' END AS split FROM placed)"""


@register(q.query("SELECT * FROM labeled", q.RETAIL, GLOBAL))
def split_global(spark, sf_dir):
    return splits.split_global(retail(spark, sf_dir))


@register(q.query("""SELECT count(*) AS n_total, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test,
  round(count(*) FILTER (WHERE split = 'train') / count(*), 6) AS frac_train, round(count(*) FILTER (WHERE split = 'val') / count(*), 6) AS frac_val, round(count(*) FILTER (WHERE split = 'test') / count(*), 6) AS frac_test FROM labeled""", *ALL))
def split_metadata(spark, sf_dir):
    return rounded(splits.split_metadata(labeled(spark, sf_dir)))


@register(q.query("SELECT * FROM spans WHERE train_max > val_min OR val_max > test_min", q.RETAIL, SHUFFLED, SPANS))
def leakage_violations(spark, sf_dir):
    return splits.leakage_violations(shuffled_labels(spark, sf_dir))


@register(q.query("SELECT * FROM spans WHERE train_max IS NOT NULL AND (train_max > val_min OR coalesce(val_max, train_max) > test_min)", q.RETAIL, SHUFFLED, SPANS))
def order_violations(spark, sf_dir):
    return splits.order_violations(shuffled_labels(spark, sf_dir))


@register(q.query("SELECT (SELECT count(*) FROM spans WHERE train_max > val_min OR val_max > test_min) AS n_users", *ALL, SPANS))
def split_leakage_count(spark, sf_dir):
    return splits.leakage_violations(labeled(spark, sf_dir)).agg(F.count("*").alias("n_users"))


@register(q.query("""SELECT count(*) AS n_rows, count(*) FILTER (WHERE user_id IS NULL) AS null_user_id, count(*) FILTER (WHERE item_id IS NULL) AS null_item_id,
  count(*) FILTER (WHERE rating IS NULL) AS null_rating, count(*) FILTER (WHERE ts IS NULL) AS null_ts, count(*) FILTER (WHERE rating < 0) AS negative_ratings FROM inter""", q.CLICKS))
def validate_counts_events(spark, sf_dir):
    return validation_counts(clicks(spark, sf_dir))


@register(q.query('SELECT "asof" FROM clock', *ALL))
def asof_clock(spark, sf_dir):
    return features.clock(train_val(spark, sf_dir)[0])


USER_FEATURES = """gaps AS (SELECT *, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, item_id, rating), ts) / 86400.0::DOUBLE AS gap FROM train),
g AS (
  SELECT user_id, count(*) AS n_interactions, count(DISTINCT item_id) AS n_items, avg(rating) AS rating_mean, coalesce(stddev_samp(rating), 0) AS rating_std, min(rating) AS rating_min, max(rating) AS rating_max,
    count(DISTINCT CAST(ts AS DATE)) AS active_days, min(ts) AS a, max(ts) AS b, avg(gap) AS gm, quantile_cont(gap, 0.5) AS gq,
    count(*) FILTER (WHERE ts >= (SELECT "asof" FROM clock) - INTERVAL 7 DAY) AS n_last_7d, count(*) FILTER (WHERE ts >= (SELECT "asof" FROM clock) - INTERVAL 30 DAY) AS n_last_30d
  FROM gaps GROUP BY user_id)"""
USER_SELECT = """SELECT user_id, n_interactions, n_items, round(n_items / n_interactions, 6) AS item_diversity, round(rating_mean, 6) AS rating_mean, round(rating_std, 6) AS rating_std, round(rating_min, 6) AS rating_min, round(rating_max, 6) AS rating_max,
  active_days, round(date_diff('second', a, b) / 86400.0::DOUBLE, 6) AS span_days, round(date_diff('second', b, (SELECT "asof" FROM clock)) / 86400.0::DOUBLE, 6) AS days_since_last,
  round(coalesce(gm, date_diff('second', a, b) / 86400.0::DOUBLE), 6) AS avg_gap_days, round(coalesce(gq, date_diff('second', a, b) / 86400.0::DOUBLE), 6) AS median_gap_days, n_last_7d, n_last_30d FROM g"""


@register(q.query(USER_SELECT, *ALL, USER_FEATURES))
def user_features(spark, sf_dir):
    return rounded(features.user_features(train_val(spark, sf_dir)[0]))


@register(q.query(USER_SELECT, q.CLICKS, q.LABELED, USER_FEATURES))
def user_features_events(spark, sf_dir):
    return rounded(features.user_features(splits.splits(splits.split_per_user(clicks(spark, sf_dir)))[0]))


@register(q.query("""SELECT item_id, count(*) AS n_interactions, count(DISTINCT user_id) AS n_users, round(avg(rating), 6) AS rating_mean, round(coalesce(stddev_samp(rating), 0), 6) AS rating_std, min(ts) AS first_ts, max(ts) AS last_ts,
  round(date_diff('second', max(ts), (SELECT "asof" FROM clock)) / 86400.0::DOUBLE, 6) AS days_since_last, count(*) FILTER (WHERE ts >= (SELECT "asof" FROM clock) - INTERVAL 7 DAY) AS n_last_7d,
  count(*) FILTER (WHERE ts >= (SELECT "asof" FROM clock) - INTERVAL 30 DAY) AS n_last_30d, round(count(*) FILTER (WHERE ts >= (SELECT "asof" FROM clock) - INTERVAL 30 DAY) / count(*), 6) AS recent_share_30d FROM train GROUP BY item_id""", *ALL))
def item_features(spark, sf_dir):
    return rounded(features.item_features(train_val(spark, sf_dir)[0]))


@register(q.query("""SELECT user_id, item_id, round(rating, 6) AS rating, ts, round((rating - m) / CASE WHEN s IS NULL OR s = 0 THEN 1 ELSE s END, 6) AS rating_z_user, round(date_diff('second', ts, (SELECT "asof" FROM clock)) / 86400.0::DOUBLE, 6) AS age_days
  FROM (SELECT *, avg(rating) OVER (PARTITION BY user_id) AS m, stddev_samp(rating) OVER (PARTITION BY user_id) AS s FROM train)""", *ALL))
def interaction_features(spark, sf_dir):
    return rounded(features.interaction_features(train_val(spark, sf_dir)[0]))


BY_USERS, BY_ROWS = (*ALL, q.graph_steps()), (*ALL, q.graph_steps("interactions"))


@register(q.query("SELECT * FROM item_support", *BY_USERS))
def item_support(spark, sf_dir):
    return graph.item_support(train_val(spark, sf_dir)[0], GRAPH)


@register(q.query("SELECT * FROM ui", *BY_USERS))
def capped_user_items(spark, sf_dir):
    return graph.capped_user_items(train_val(spark, sf_dir)[0], GRAPH)


@register(q.query("SELECT i, j, c AS cooc_cnt FROM cooc", *BY_USERS))
def cooccurrence(spark, sf_dir):
    return graph.cooccurrence(graph.capped_user_items(train_val(spark, sf_dir)[0], GRAPH), GRAPH)


EDGE = "SELECT src_item, dst_item, round(cosine, 6) AS cosine, cooc_cnt, src_cnt, dst_cnt FROM edges"


@register(q.query(EDGE, *BY_USERS))
def item_cosine_by_users(spark, sf_dir):
    return rounded(graph.item_edges(train_val(spark, sf_dir)[0], GRAPH))


@register(q.query(EDGE, *BY_ROWS))
def item_cosine_by_interactions(spark, sf_dir):
    return rounded(graph.item_edges(train_val(spark, sf_dir)[0], graph.GraphConfig(min_support=20, min_cooc=2, min_cosine=0.05, norm="interactions")))


def item_graph(train: DataFrame) -> DataFrame:
    return graph.build_graph(train, GRAPH, auto_tune=False)


def ranking_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, val and the graph, each written once."""
    train, val = train_val(spark, sf_dir)
    return train, val, materialize(item_graph(train), "graph")


@register(q.query("SELECT src_item, dst_item, round(cosine, 6) AS cosine, cooc_cnt, src_cnt, dst_cnt, rk FROM graph", *BY_USERS))
def graph_topk_neighbors(spark, sf_dir):
    return rounded(item_graph(train_val(spark, sf_dir)[0]))


@register(q.query("SELECT degree, count(*) AS n FROM (SELECT src_item, count(*) AS degree FROM graph GROUP BY 1) GROUP BY 1", *BY_USERS))
def graph_degree_histogram(spark, sf_dir):
    return reports.degree_counts(item_graph(train_val(spark, sf_dir)[0]))


@register(q.query("SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS cluster_id FROM (SELECT DISTINCT item_id FROM train)", *ALL))
def dense_item_clusters(spark, sf_dir):
    return components.dense_item_clusters(train_val(spark, sf_dir)[0])


PARTS = """e AS (SELECT src_item AS a, dst_item AS b FROM edges WHERE cosine >= 0.05 AND cooc_cnt >= 5),
reach AS (SELECT DISTINCT a AS n, a AS m FROM e UNION SELECT r.n, e.b FROM reach r JOIN e ON e.a = r.m),
part AS (SELECT n AS item_id, min(m) AS c FROM reach GROUP BY n), sized AS (SELECT c, count(*) AS cluster_size FROM part GROUP BY c HAVING count(*) >= 2),
numbered AS (SELECT c, cluster_size, row_number() OVER (ORDER BY cluster_size DESC, c) - 1 AS cluster_id FROM sized),
clusters AS (SELECT item_id, cluster_id, cluster_size FROM part JOIN numbered ON part.c = numbered.c)"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_item_clusters(graph.item_edges(train_val(spark, sf_dir)[0], GRAPH), CLUSTERS)


@register(q.query("SELECT * FROM clusters", *BY_USERS, PARTS).replace("WITH", "WITH RECURSIVE", 1))
def connected_item_clusters(spark, sf_dir):
    return clusters(spark, sf_dir)


@register(q.query("SELECT cluster_id, count(*) AS n FROM clusters GROUP BY 1 ORDER BY n DESC, cluster_id LIMIT 30", *BY_USERS, PARTS).replace("WITH", "WITH RECURSIVE", 1))
def cluster_sizes(spark, sf_dir):
    return reports.cluster_sizes(clusters(spark, sf_dir))


RANK = (*BY_USERS, q.RANKING)


@register(q.query("SELECT item_id, round(popularity, 6) AS popularity FROM pop", *RANK))
def item_popularity(spark, sf_dir):
    return rounded(ranking.popularity(train_val(spark, sf_dir)[0]))


@register(q.query("SELECT user_id, item_id, round(rating, 6) AS rating FROM history", *RANK))
def user_history(spark, sf_dir):
    return rounded(ranking.user_history(train_val(spark, sf_dir)[0]))


@register(q.query("SELECT * FROM eligible", *RANK))
def eligible_users(spark, sf_dir):
    train, val = train_val(spark, sf_dir)
    return ranking.eligible_users(train, val, ranking.user_history(train))


@register(q.query("SELECT item_id, round(popularity, 6) AS popularity FROM fallback", *RANK))
def popularity_fallback(spark, sf_dir):
    return rounded(ranking.popularity_fallback(ranking.popularity(train_val(spark, sf_dir)[0])))


@register(q.query("SELECT user_id, count(*) AS n, round(sum(mass), 6) AS mass FROM unseen GROUP BY 1", *RANK))
def unseen_candidates(spark, sf_dir):
    train, _, items = ranking_inputs(spark, sf_dir)
    rows = ranking.unseen_candidates(ranking.user_history(train), items)
    return rounded(rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("mass").alias("mass")))


@register(q.query("SELECT user_id, item_id, round(score, 6) AS score FROM candidates", *RANK))
def graph_candidates(spark, sf_dir):
    train, _, items = ranking_inputs(spark, sf_dir)
    return rounded(ranking.graph_candidates(ranking.user_history(train), items, ranking.popularity(train)))


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.recommend(*ranking_inputs(spark, sf_dir))


def evaluated(spark: SparkSession, sf_dir: str, fixed_k: bool = False) -> DataFrame:
    train, val, items = ranking_inputs(spark, sf_dir)
    return rounded(metrics.evaluate_topk(materialize(ranking.recommend(train, val, items), "topk"), val, fixed_k=fixed_k))


@register(q.query("SELECT user_id, item_id, round(score, 6) AS score, rank FROM topk", *RANK))
def topk_recommendations(spark, sf_dir):
    return rounded(topk(spark, sf_dir))


@register(q.query("SELECT user_id, item_id, round(popularity, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY popularity DESC, item_id) AS rank FROM eligible, (SELECT * FROM fallback ORDER BY popularity DESC, item_id LIMIT 50)", *RANK))
def topk_popularity_only(spark, sf_dir):
    return rounded(ranking.recommend(*train_val(spark, sf_dir), None))


def _metrics_sql(denominator: str) -> str:
    return q.query(f"SELECT CAST(k AS INTEGER) AS k, count(*) AS n_users_eval, round(avg(h / {denominator}), 6) AS \"precision\", round(avg(h / g), 6) AS recall, round(avg(CASE WHEN h > 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(dcg / idcg), 6) AS ndcg, round(avg(ap / least(g, k)), 6) AS map FROM per_user GROUP BY k", *RANK, q.METRICS_K)


@register(_metrics_sql("n"))
def ranking_metrics_returned(spark, sf_dir):
    return evaluated(spark, sf_dir)


@register(_metrics_sql("k"))
def ranking_metrics_fixed_k(spark, sf_dir):
    return evaluated(spark, sf_dir, fixed_k=True)


@register(q.query("SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items FROM topk", *RANK))
def recommendation_coverage(spark, sf_dir):
    return metrics.coverage(topk(spark, sf_dir))


@register(q.query("SELECT user_id, round(inactivity_days, 6) AS inactivity_days, CAST(inactivity_days >= 90 AS INTEGER) AS label FROM inactive", q.RETAIL, q.INACTIVE))
def churn_labels(spark, sf_dir):
    return rounded(churn.churn_labels(retail(spark, sf_dir)))


@register(q.query("SELECT user_id, round(inactivity_days, 6) AS inactivity_days, CAST(inactivity_days >= (SELECT quantile_cont(inactivity_days, 0.8) FROM inactive) AS INTEGER) AS label FROM inactive", q.CLICKS, q.INACTIVE))
def churn_labels_fallback_events(spark, sf_dir):
    return rounded(churn.two_class_labels(clicks(spark, sf_dir)))


@register()
def churn_scores(spark, sf_dir):
    train, _ = train_val(spark, sf_dir)
    return churn.train_and_score(features.user_features(train), churn.two_class_labels(train))[0]


MATRIX = ("n_interactions", "rating_mean", "rating_std", "span_days", "median_gap_days")
_Z = ", ".join(f"round(({c} - avg({c}) FILTER (WHERE part = 'train') OVER ()) / coalesce(nullif(stddev_pop({c}) FILTER (WHERE part = 'train') OVER (), 0), 1), 6) AS {c}" for c in MATRIX)


@register(q.query(f"""SELECT user_id, label, part, {_Z} FROM (
  SELECT f.*, CASE WHEN row_number() OVER (ORDER BY f.user_id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'val' END AS part, CAST(inactivity_days >= 90 AS INTEGER) AS label
  FROM ({USER_SELECT}) f JOIN inactive i ON i.user_id = f.user_id)""", *ALL, USER_FEATURES, q.INACTIVE))
def churn_matrix(spark, sf_dir):
    """What the churn model is fitted on: labels, the cut by user, imputed and scaled features."""
    train, _ = train_val(spark, sf_dir)
    rows = rounded(features.user_features(train)).select("user_id", *MATRIX)
    return rounded(churn.churn_matrix(rows, churn.churn_labels(retail(spark, sf_dir)))[0])


def scores(interactions: DataFrame) -> DataFrame:
    """A churn probability that SQL can state."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("inactivity_days") - 60) / 45))
    return churn.inactivity(interactions).select("user_id", F.round(p, 6).alias("p_churn"))


@register(q.query("""SELECT count(*) AS n_users, round(avg(y), 6) AS churn_rate, round((SELECT sum(w) FROM (SELECT p_churn, sum(y) OVER (ORDER BY p_churn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS p,
    y * ((SELECT count(*) FROM s z WHERE z.y = 0 AND z.p_churn < s.p_churn) + 0.5 * (SELECT count(*) FROM s z WHERE z.y = 0 AND z.p_churn = s.p_churn)) AS w FROM s)) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc,
    round((SELECT sum((r - r0) * (c + c0) / 2) FROM (SELECT r, c, lag(r, 1, 0) OVER w AS r0, lag(c, 1, 1) OVER w AS c0 FROM curve WINDOW w AS (ORDER BY p_churn DESC))), 6) AS pr_auc FROM s""",
    q.RETAIL, q.RISK, "s AS (SELECT p_churn, n_interactions % 2 AS y FROM risk)",
    """curve AS (SELECT p_churn, CAST(sum(ones) OVER d AS DOUBLE) / sum(ones) OVER () AS r, CAST(sum(ones) OVER d AS DOUBLE) / sum(n) OVER d AS c
       FROM (SELECT p_churn, sum(y) AS ones, count(*) AS n FROM s GROUP BY 1) WINDOW d AS (ORDER BY p_churn DESC ROWS UNBOUNDED PRECEDING))"""))
def churn_auc(spark, sf_dir):
    odd = risk(spark, sf_dir).select("p_churn", (F.col("n_interactions") % 2).alias("y"))
    return rounded(churn.auc(odd, "p_churn", "y"))


LTV_SELECT = "SELECT user_id, n_interactions, n_distinct_items, round(recency_days, 6) AS recency_days, expected_months, round(ltv_usd, 6) AS ltv_usd FROM ltv"


@register(q.query(LTV_SELECT, q.RETAIL, q.LTV))
def user_ltv(spark, sf_dir):
    return rounded(revenue.user_ltv(retail(spark, sf_dir)))


@register(q.query(LTV_SELECT, q.CLICKS, q.LTV))
def user_ltv_events(spark, sf_dir):
    return rounded(revenue.user_ltv(clicks(spark, sf_dir)))


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, as are the interactions behind it: scores and values both read those."""
    rows = materialize(retail(spark, sf_dir), "interactions")
    return materialize(revenue.revenue_risk(scores(rows), revenue.user_ltv(rows)), "risk")


R = "user_id, round(p_churn, 6) AS p_churn, round(ltv_usd, 6) AS ltv_usd, round(revenue_at_risk_usd, 6) AS revenue_at_risk_usd, expected_months, n_interactions, n_distinct_items, round(recency_days, 6) AS recency_days, risk_bucket"


@register(q.query(f"SELECT {R} FROM risk", q.RETAIL, q.RISK))
def revenue_risk(spark, sf_dir):
    return rounded(risk(spark, sf_dir))


@register(q.query(f"SELECT {R}, rn, n FROM (SELECT *, row_number() OVER (ORDER BY revenue_at_risk_usd DESC, p_churn DESC, ltv_usd DESC, user_id) AS rn, count(*) OVER () AS n FROM risk) WHERE rn <= ceil(n * 0.02)", q.RETAIL, q.RISK))
def revenue_risk_top(spark, sf_dir):
    return rounded(revenue.revenue_risk_top(risk(spark, sf_dir)))


@register(q.query("SELECT count(*) AS n_users, round(avg(p_churn), 4) AS avg_p_churn, round(avg(ltv_usd), 4) AS avg_ltv_usd, round(sum(revenue_at_risk_usd), 4) AS total_revenue_at_risk_usd, round(coalesce(sum(revenue_at_risk_usd) FILTER (WHERE risk_bucket IN ('high', 'critical')), 0), 4) AS high_critical_risk_usd FROM risk", q.RETAIL, q.RISK))
def revenue_risk_summary(spark, sf_dir):
    return rounded(revenue.revenue_risk_summary(risk(spark, sf_dir)), 4)


@register(q.query("SELECT round(quantile_cont(p_churn, 0.5), 6) AS p_median, round(quantile_cont(ltv_usd, 0.5), 6) AS ltv_median, round(quantile_cont(revenue_at_risk_usd, 0.9), 6) AS risk_q90 FROM risk", q.RETAIL, q.RISK))
def risk_quadrants(spark, sf_dir):
    return rounded(reports.risk_quadrants(risk(spark, sf_dir)))


@register(q.query(f"SELECT {R}, risk_tier, ltv_tier, intervention FROM policy", q.RETAIL, q.POLICY))
def intervention_policy(spark, sf_dir):
    return rounded(interventions.initial_policy(risk(spark, sf_dir), POLICY))


EFFECTS = f"{R}, risk_tier, ltv_tier, intervention, " + ", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in ("p_churn_new", "revenue_at_risk_new_usd", "intervention_cost_usd", "risk_reduction_usd", "net_value_usd"))


def _four_places(df: DataFrame) -> DataFrame:
    singles = [c for c, t in df.dtypes if t == "float"]
    return rounded(df.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in singles}))


@register(q.query(f"SELECT {EFFECTS} FROM effects", q.RETAIL, q.POLICY))
def intervention_effects(spark, sf_dir):
    return _four_places(interventions.intervention_effects(interventions.initial_policy(risk(spark, sf_dir), POLICY), POLICY))


@register(q.query(f"SELECT {EFFECTS} FROM gated", q.RETAIL, q.POLICY))
def intervention_roi_gated(spark, sf_dir):
    return _four_places(interventions.simulate_interventions(risk(spark, sf_dir), POLICY))


@register(q.query("SELECT count(*) AS n_users, " + ", ".join(f"count(*) FILTER (WHERE intervention = '{a}') AS n_{a}" for a in ("discount_2mo", "content_boost", "email_nudge", "none")) + """,
  round(sum(revenue_at_risk_usd), 3) AS risk_before_usd, round(sum(CAST(revenue_at_risk_new_usd AS DOUBLE)), 3) AS risk_after_usd, round(sum(CAST(risk_reduction_usd AS DOUBLE)), 3) AS risk_reduction_usd, round(sum(CAST(intervention_cost_usd AS DOUBLE)), 3) AS cost_usd,
  round(sum(CAST(net_value_usd AS DOUBLE)), 3) AS net_value_usd, round(avg(p_churn), 3) AS avg_p_churn, round(avg(CAST(p_churn_new AS DOUBLE)), 3) AS avg_p_churn_new, round(avg(CAST(risk_reduction_usd AS DOUBLE)), 3) AS avg_risk_reduction_usd, round(avg(CAST(net_value_usd AS DOUBLE)), 3) AS avg_net_value_usd FROM gated""", q.RETAIL, q.POLICY))
def intervention_summary(spark, sf_dir):
    return rounded(interventions.intervention_summary(interventions.simulate_interventions(risk(spark, sf_dir), POLICY)), 3)


USERS = "users AS (SELECT c_custkey AS user_id FROM customer)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"))


@register(q.query("SELECT user_id, CASE WHEN u < 0.5 THEN 'treatment' ELSE 'control' END AS variant FROM unit", USERS, q.unit("retention_ab")))
def ab_assign_2arm(spark, sf_dir):
    return experiments.assign_variants(users(spark, sf_dir))


ARM = "CASE WHEN u < 0.05 THEN 'discount' WHEN u < 0.05::DOUBLE + 0.45::DOUBLE THEN 'content' ELSE 'control' END AS variant"


@register(q.query(f"SELECT user_id, {ARM} FROM unit", USERS, q.unit("retention_ab")))
def ab_assign_3arm(spark, sf_dir):
    return experiments.assign_variants_3arm(users(spark, sf_dir))


ARMS = q.RETAIL, q.POLICY, "users AS (SELECT user_id FROM risk)", q.unit("retention_ab"), f"""arms AS (SELECT user_id, {ARM} FROM unit),
seen AS (
  SELECT variant, CASE WHEN variant = 'control' THEN revenue_at_risk_usd ELSE CAST(revenue_at_risk_new_usd AS DOUBLE) END AS y, CASE WHEN variant = 'control' THEN 0 ELSE CAST(intervention_cost_usd AS DOUBLE) END AS cost,
         CASE WHEN variant = 'control' THEN 0 ELSE CAST(net_value_usd AS DOUBLE) END AS net
  FROM gated g JOIN arms a ON a.user_id = g.user_id),
stats AS (SELECT variant, count(*) AS n, avg(y) AS mean_y, var_samp(y) AS var_y, sum(cost) AS cost_usd, sum(net) AS net_value_usd FROM seen GROUP BY variant)"""


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows, written."""
    base = risk(spark, sf_dir)
    return materialize(experiments.arm_stats(experiments.observed(experiments.outcomes(base, interventions.simulate_interventions(base, POLICY)))), "arms")


@register(q.query("SELECT variant, n, round(mean_y, 3) AS mean_y, round(var_y, 3) AS var_y, round(cost_usd, 3) AS cost_usd, round(net_value_usd, 3) AS net_value_usd FROM stats", *ARMS))
def ab_arm_stats(spark, sf_dir):
    return rounded(arms(spark, sf_dir), 3)


@register(q.query("""SELECT s.variant, round(s.mean_y - c.mean_y, 3) AS effect, round(sqrt(s.var_y / s.n + c.var_y / c.n), 3) AS se, round((s.mean_y - c.mean_y) / sqrt(s.var_y / s.n + c.var_y / c.n), 3) AS z, round(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x), 3) AS p_value, round((s.mean_y - c.mean_y) / c.mean_y, 3) AS lift
  FROM stats s, stats c, LATERAL (SELECT abs((s.mean_y - c.mean_y) / sqrt(s.var_y / s.n + c.var_y / c.n)) / sqrt(2.0::DOUBLE) AS x), LATERAL (SELECT 1 / (1 + 0.3275911 * x) AS t) WHERE c.variant = 'control' AND s.variant <> 'control'""", *ARMS))
def ab_ztest(spark, sf_dir):
    return rounded(experiments.tests_vs_control(arms(spark, sf_dir)), 3)


@register(q.query("SELECT variant, n, round(mean_y, 3) AS mean_y, round(mean_y - 1.959963984540054 * sqrt(var_y / n), 3) AS lo, round(mean_y + 1.959963984540054 * sqrt(var_y / n), 3) AS hi FROM stats", *ARMS))
def ab_arm_bars(spark, sf_dir):
    return rounded(reports.arm_bars(arms(spark, sf_dir)), 3)


# The SQL's numbers are the normal quantiles of 0.975 and 0.8.
@register(q.query("SELECT CAST(ceil(2 * pow((1.959963984540054 + 0.8416212335729143) * stddev_samp(revenue_at_risk_usd) / (avg(revenue_at_risk_usd) * 0.03), 2)) AS BIGINT) AS n_per_arm FROM risk", q.RETAIL, q.RISK))
def ab_sample_size(spark, sf_dir):
    return experiments.sample_size(risk(spark, sf_dir).agg(F.avg("revenue_at_risk_usd").alias("mean"), F.stddev_samp("revenue_at_risk_usd").alias("std")))


@register(q.query("""SELECT s.variant, s.n, round(s.net_value_usd, 3) AS net_value_usd, round(s.mean_y - c.mean_y, 3) AS effect FROM stats s LEFT JOIN stats c ON c.variant = 'control' AND s.variant <> 'control'
  UNION ALL SELECT 'all', count(*), NULL, NULL FROM risk""", *ARMS))
def ab_report(spark, sf_dir):
    """The three-arm report as rows: an arm's users, value and effect, and all users."""
    base = risk(spark, sf_dir)
    r = experiments.experiment_report(base, interventions.simulate_interventions(base, POLICY))
    rows = [(a, n, round(r["arm_net_value"][a], 3), round(r["tests_vs_control"][a]["effect"], 3) if a in r["tests_vs_control"] else None) for a, n in r["counts"].items()]
    return spark.createDataFrame([*rows, ("all", r["n_total"], None, None)], "variant string, n long, net_value_usd double, effect double")


@register(q.query("SELECT CAST(date_trunc('month', ts) AS DATE) AS month, split, count(*) AS n FROM labeled GROUP BY 1, 2", *ALL))
def monthly_split_counts(spark, sf_dir):
    return reports.monthly_split_counts(labeled(spark, sf_dir))


@register(q.query("""SELECT CAST(bin AS INTEGER) AS bin, round(a + bin * w, 6) AS lo, round(a + (bin + 1) * w, 6) AS hi, n FROM (
  SELECT least(49, CAST(floor((c - a) / w) AS BIGINT)) AS bin, a, w, count(*) AS n FROM (SELECT CAST(c AS DOUBLE) AS c, CAST(min(c) OVER () AS DOUBLE) AS a, (max(c) OVER () - min(c) OVER ()) / 50.0::DOUBLE AS w FROM (SELECT count(*) AS c FROM inter GROUP BY user_id)) GROUP BY 1, 2, 3)""", q.RETAIL))
def interactions_histogram(spark, sf_dir):
    return rounded(reports.histogram(retail(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("c")), "c"))


@register(q.query("""SELECT 'split' AS phase, 'n_total' AS metric, CAST(count(*) AS DOUBLE) AS value FROM inter
UNION ALL SELECT 'risk', 'n_users', CAST(count(*) AS DOUBLE) FROM risk UNION ALL SELECT 'risk', 'avg_ltv_usd', round(avg(ltv_usd), 4) FROM risk""", q.RETAIL, q.RISK))
def run_summary(spark, sf_dir):
    parts = {"split": splits.split_metadata(labeled(spark, sf_dir)).select("n_total"), "risk": revenue.revenue_risk_summary(risk(spark, sf_dir)).select("n_users", "avg_ltv_usd")}
    return rounded(reports.summary_table(parts), 4)


@register(q.query("SELECT user_id, CAST(count(DISTINCT item_id) AS BIGINT) AS n_items, max(epoch_us(ts)) AS last_us FROM inter GROUP BY 1", q.CLICKS))
def interactions_events(spark, sf_dir):
    return clicks(spark, sf_dir).groupBy("user_id").agg(F.countDistinct("item_id").alias("n_items"), F.max(epoch_micros(F.col("ts"))).alias("last_us"))


# Sources and sinks: written to the shared folder, read back, and held against the rows that went in.


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register(q.query("SELECT user_id, item_id, rating, date_trunc('second', ts) AS ts FROM inter", q.RETAIL))
def csv_ingest(spark, sf_dir):
    """Raw ratings written as CSV shards, read with their schema and brought to interactions."""
    path = _folder(spark, "ratings")
    io.write_ratings_csv(retail(spark, sf_dir), path)
    return io.read_ratings_csv(spark, path)


@register(q.query("SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, CAST(1 AS BIGINT) AS n_files FROM inter", q.CLICKS))
def compacted_sink(spark, sf_dir):
    """Shards replaced by one file; a second write leaves nothing of the first."""
    path = _folder(spark, "compacted")
    rows = clicks(spark, sf_dir)
    io.write_parquet(rows, path, files=4)
    io.write_parquet(rows, path, files=1)
    back = io.read_parquet(spark, path, "user_id")
    return back.agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_users")).withColumn("n_files", F.lit(len(back.inputFiles())).cast("long"))


@register(q.query("SELECT split, count(*) AS n, sum(item_id) AS items, (SELECT count(*) FROM labeled) AS n_total FROM labeled GROUP BY 1", *ALL))
def split_sink(spark, sf_dir):
    """The labeled table by split, with its metadata beside it, read back."""
    path = _folder(spark, "splits")
    rows = labeled(spark, sf_dir)
    io.write_splits(rows, path, splits.split_metadata(rows).first().asDict())
    total = io.read_json(spark, f"{path}.metadata.json")["n_total"]
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("item_id").alias("items")).withColumn("n_total", F.lit(total).cast("long"))


@register(q.query("SELECT user_id, item_id, rating, ts, CAST(0 AS BIGINT) AS n_unordered FROM labeled WHERE split = 'val'", *ALL))
def ordered_sink(spark, sf_dir):
    """Rows written in the order of user and item; ``n_unordered`` counts neighbours of a file that are not."""
    path = _folder(spark, "ordered")
    io.write_parquet(train_val(spark, sf_dir)[1], path, order_by=("user_id", "item_id"), files=1)
    back = spark.read.parquet(path)
    key = F.struct("user_id", "item_id")
    at = back.select(F.input_file_name().alias("file"), F.col("_metadata.row_index").alias("i"), key.alias("key"))
    after = at.select("file", (F.col("i") - 1).alias("i"), F.col("key").alias("then"))
    wrong = at.join(after, ["file", "i"]).where("then < key").count()
    return back.withColumn("n_unordered", F.lit(wrong).cast("long"))


@register(q.query("SELECT count(*) AS n_there, CAST(0 AS BIGINT) AS n_missing FROM inter", q.CLICKS))
def optional_source(spark, sf_dir):
    """A table that is there, and one that is not: an empty relation of the same schema stands in."""
    path = _folder(spark, "optional")
    io.write_parquet(clicks(spark, sf_dir), path)
    count = lambda p: io.read_optional(spark, p, INTERACTIONS).agg(F.count("*").alias("n"))
    return count(path).withColumnRenamed("n", "n_there").crossJoin(count(f"{path}-none").withColumnRenamed("n", "n_missing"))  # one row each


@register("SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS item_id, value AS rating, CAST(to_timestamp(floor(epoch(ts))) AT TIME ZONE 'UTC' AS TIMESTAMP) AS ts FROM events")
def canonical_interactions(spark, sf_dir):
    """Narrow integers, single precision and epoch seconds brought to the canonical types."""
    rows = clicks(spark, sf_dir)
    raw = rows.select(F.col("user_id").cast("int"), F.col("item_id").cast("string"), "rating", F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"))
    return canonicalize(raw)


@register(q.query("SELECT DISTINCT user_id, item_id, rating, ts, count(DISTINCT split) OVER (PARTITION BY user_id, item_id, rating, ts) AS n_splits FROM labeled QUALIFY n_splits > 1", q.RETAIL, SHUFFLED))
def split_overlaps(spark, sf_dir):
    return splits.overlaps(shuffled_labels(spark, sf_dir))


@register(q.query("SELECT (SELECT count(*) FROM (SELECT user_id, item_id, rating, ts FROM labeled GROUP BY ALL HAVING count(DISTINCT split) > 1)) AS n_rows", *ALL))
def split_overlap_count(spark, sf_dir):
    return splits.overlaps(labeled(spark, sf_dir)).agg(F.count("*").alias("n_rows"))


@register(q.query("SELECT src_item, dst_item, round(cosine, 6) AS cosine, cooc_cnt, src_cnt, dst_cnt, rk FROM graph", q.RETAIL, "train AS (SELECT * FROM inter WHERE user_id <= 40)",
    "n_items AS (SELECT count(DISTINCT item_id) AS k FROM train)", q.graph_steps(support=1, cooc=1, cosine=0.0, topk=100).replace("n BETWEEN 2 AND 300", "n BETWEEN 1 AND 300").replace("rk <= 100", "rk <= greatest(1, least(100, (SELECT k FROM n_items) - 1))")))
def graph_auto_tuned(spark, sf_dir):
    """Forty users are a tiny table: thresholds relax."""
    train = materialize(retail(spark, sf_dir).where("user_id <= 40"), "tiny")
    return rounded(graph.build_graph(train, graph.GraphConfig(), auto_tune=True))


@register(q.query("SELECT cooc_cnt, CAST(least(19, floor(cosine * 20)) AS INTEGER) AS bin, count(*) AS n FROM edges GROUP BY 1, 2", *BY_USERS))
def cosine_against_cooccurrence(spark, sf_dir):
    return reports.cosine_against_cooccurrence(graph.item_edges(train_val(spark, sf_dir)[0], GRAPH))


@register(q.query("SELECT count(*) AS n, CAST(count(*) AS BIGINT) AS n_known FROM (SELECT DISTINCT user_id FROM risk LIMIT 500)", q.RETAIL, q.RISK))
def plot_sample(spark, sf_dir):
    """Five hundred users for a scatter plot, the same every time; ``n_known`` of them are users, each once."""
    base = risk(spark, sf_dir)
    some = reports.plot_sample(base, "user_id", 500).select("user_id")
    return some.agg(F.count("*").alias("n")).crossJoin(base.join(some.distinct(), "user_id", "left_semi").agg(F.count("*").alias("n_known")))  # one row each
