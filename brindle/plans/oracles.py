"""DuckDB SQL with the same rows as the catalog's queries, built from shared steps."""

from __future__ import annotations

RETAIL = """inter AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(0.5 * (1 + (CAST(l_quantity AS BIGINT) % 10)) AS DOUBLE) AS rating, CAST(o_orderdate AS TIMESTAMP) AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CLICKS = """inter AS (
  SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS item_id, value AS rating, CAST(ts AS TIMESTAMP) AS ts FROM events)"""
LABELED = """ranked AS (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id, rating) AS pos FROM inter
), ends AS (
  SELECT *, greatest(1, CAST(floor(n * 0.70) AS BIGINT)) AS a, greatest(greatest(1, CAST(floor(n * 0.70) AS BIGINT)), CAST(floor(n * 0.85) AS BIGINT)) AS b FROM ranked
), labeled AS (
  SELECT user_id, item_id, rating, ts, CASE WHEN n < 5 THEN 'train' WHEN pos <= a THEN 'train' WHEN pos <= b THEN 'val' ELSE 'test' END AS split FROM ends
), train AS (SELECT * FROM labeled WHERE split = 'train'), val AS (SELECT * FROM labeled WHERE split = 'val'),
clock AS (SELECT max(ts) AS "asof" FROM train)"""


def graph_steps(norm: str = "users", support: int = 20, cooc: int = 2, cosine: float = 0.05, topk: int = 100) -> str:
    degree = "SELECT item_id, support AS d FROM item_support" if norm == "interactions" else "SELECT item_id, count(*) AS d FROM ui GROUP BY item_id"
    return f"""item_support AS (SELECT item_id, count(*) AS support FROM train GROUP BY item_id HAVING count(*) >= {support}),
ui0 AS (SELECT DISTINCT user_id, item_id FROM train WHERE item_id IN (SELECT item_id FROM item_support)),
ui AS (SELECT user_id, item_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ui0) WHERE n BETWEEN 2 AND 300),
degree AS ({degree}),
cooc AS (SELECT a.item_id AS i, b.item_id AS j, count(*) AS c FROM ui a JOIN ui b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY 1, 2 HAVING count(*) >= {cooc}),
half AS (SELECT i, j, c, di.d AS ci, dj.d AS cj, c / sqrt(CAST(di.d AS DOUBLE) * dj.d) AS cosine FROM cooc JOIN degree di ON di.item_id = i JOIN degree dj ON dj.item_id = j),
edges AS (
  SELECT i AS src_item, j AS dst_item, cosine, c AS cooc_cnt, ci AS src_cnt, cj AS dst_cnt FROM half WHERE cosine >= {cosine}
  UNION ALL SELECT j, i, cosine, c, cj, ci FROM half WHERE cosine >= {cosine}),
graph AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_item ORDER BY cosine DESC, cooc_cnt DESC, dst_item) AS rk FROM edges) WHERE rk <= {topk})"""


RANKING = """pop AS (SELECT item_id, log10(1 + count(*)) AS popularity FROM train GROUP BY item_id),
history AS (SELECT user_id, item_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS rn FROM train WHERE rating >= 4.0) WHERE rn <= 200),
eligible AS (
  SELECT u.user_id, coalesce(n, 0) AS n_hist FROM (SELECT user_id FROM train UNION SELECT user_id FROM val) u
  LEFT JOIN (SELECT user_id, count(*) AS n FROM history GROUP BY 1) h ON h.user_id = u.user_id),
fallback AS (SELECT item_id, popularity FROM pop ORDER BY popularity DESC, item_id LIMIT 300),
mass AS (SELECT user_id, dst_item AS item_id, sum(cosine) AS mass FROM history h JOIN graph ON h.item_id = src_item GROUP BY 1, 2),
unseen AS (SELECT * FROM mass m WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.user_id = m.user_id AND h.item_id = m.item_id)),
scored AS (SELECT user_id, u.item_id, round(mass + 0.15 * coalesce(popularity, 0), 9) AS score FROM unseen u LEFT JOIN pop ON pop.item_id = u.item_id),
candidates AS (SELECT user_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rn FROM scored) WHERE rn <= 300),
pool AS (
  SELECT user_id, item_id, popularity AS score FROM eligible, fallback WHERE n_hist < 5
  UNION ALL SELECT c.user_id, item_id, score FROM candidates c JOIN eligible e ON e.user_id = c.user_id WHERE n_hist >= 5),
topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM pool) WHERE rank <= 50)"""

INACTIVE = """inactive AS (SELECT user_id, (epoch_us((SELECT max(ts) FROM inter)) - epoch_us(max(ts))) / 86400e6 AS inactivity_days FROM inter GROUP BY user_id)"""
LTV = (
    INACTIVE
    + """, base AS (SELECT user_id, count(*) AS n_interactions, count(DISTINCT item_id) AS n_distinct_items FROM inter GROUP BY user_id),
ltv AS (
  SELECT b.user_id, n_interactions, n_distinct_items, inactivity_days AS recency_days, m AS expected_months, CAST(15.49 * m AS DOUBLE) AS ltv_usd
  FROM (SELECT b.*, inactivity_days, CAST(greatest(1, least(24, round(2 + 1.2 * ln(1 + n_interactions) + 0.8 * ln(1 + n_distinct_items) - 0.08 * inactivity_days))) AS BIGINT) AS m
        FROM base b JOIN inactive i ON i.user_id = b.user_id) b)"""
)
RISK = (
    LTV
    + """, score AS (SELECT user_id, round(1 / (1 + exp(-(inactivity_days - 60) / 45)), 6) AS p_churn FROM inactive),
risk AS (
  SELECT s.user_id, p_churn, ltv_usd, p_churn * ltv_usd AS revenue_at_risk_usd, expected_months, n_interactions, n_distinct_items, recency_days,
         CASE WHEN p_churn * ltv_usd >= 100 THEN 'critical' WHEN p_churn * ltv_usd >= 50 THEN 'high' WHEN p_churn * ltv_usd >= 20 THEN 'medium' ELSE 'low' END AS risk_bucket
  FROM score s JOIN ltv l ON l.user_id = s.user_id)"""
)


def _effects(source: str) -> str:
    p = "least(1.0, p_churn * CASE intervention WHEN 'discount_2mo' THEN 0.70 WHEN 'content_boost' THEN 0.85 WHEN 'email_nudge' THEN 0.92 ELSE 1.0 END::DOUBLE)"
    cost = "CASE WHEN intervention = 'discount_2mo' THEN CAST(0.20 AS DOUBLE) * 15.49::DOUBLE * 2 ELSE 0 END"
    return f"""SELECT user_id, p_churn, ltv_usd, revenue_at_risk_usd, expected_months, n_interactions, n_distinct_items, recency_days, risk_bucket, risk_tier, ltv_tier, intervention,
  CAST({p} AS REAL) AS p_churn_new, CAST(ltv_usd * {p} AS REAL) AS revenue_at_risk_new_usd, CAST({cost} AS REAL) AS intervention_cost_usd,
  CAST(revenue_at_risk_usd - ltv_usd * {p} AS REAL) AS risk_reduction_usd, CAST(revenue_at_risk_usd - ltv_usd * {p} - {cost} AS REAL) AS net_value_usd FROM {source}"""


POLICY = (
    RISK
    + f""", cuts AS (SELECT quantile_cont(ltv_usd, 0.8) AS qh, quantile_cont(ltv_usd, 0.5) AS qm FROM risk),
tiers AS (
  SELECT risk.*, CASE WHEN p_churn >= 0.7 THEN 'high' WHEN p_churn >= 0.4 THEN 'mid' ELSE 'low' END AS risk_tier,
         CASE WHEN ltv_usd >= qh THEN 'high' WHEN ltv_usd >= qm THEN 'mid' ELSE 'low' END AS ltv_tier FROM risk, cuts),
wished AS (
  SELECT *, CASE WHEN risk_tier = 'high' AND ltv_tier = 'high' THEN 'discount_2mo' WHEN risk_tier = 'high' THEN 'content_boost' WHEN risk_tier = 'mid' THEN 'email_nudge' ELSE 'none' END AS wish FROM tiers),
policy AS (
  SELECT * EXCLUDE (wish, rn), CASE WHEN rn <= CASE wish WHEN 'discount_2mo' THEN 20 WHEN 'content_boost' THEN 400 WHEN 'email_nudge' THEN 100 END THEN wish ELSE 'none' END AS intervention
  FROM (SELECT *, row_number() OVER (PARTITION BY wish ORDER BY revenue_at_risk_usd DESC, p_churn DESC, user_id) AS rn FROM wished)),
effects AS ({_effects("policy")}),
regated AS (
  SELECT * REPLACE (CASE WHEN intervention = 'discount_2mo' AND CAST(risk_reduction_usd AS DOUBLE) < CAST(intervention_cost_usd AS DOUBLE) * 1.10 THEN 'content_boost' ELSE intervention END AS intervention) FROM effects),
gated AS ({_effects("regated")})"""
)


def unit(exp: str) -> str:
    """The hash of ``exp:user_id`` in [0, 1), from the first 64 bits of SHA-256."""
    digits = " + ".join(f"CAST(instr('0123456789abcdef', substr(h, {i + 1}, 1)) - 1 AS HUGEINT) * {16 ** (15 - i)}" for i in range(16))
    return f"hashed AS (SELECT user_id, sha256('{exp}:' || user_id) AS h FROM users), unit AS (SELECT user_id, CAST(({digits}) % 1000000000000 AS DOUBLE) / 1e12 AS u FROM hashed)"


METRICS_K = """ks AS (SELECT unnest([5, 10, 20, 50]) AS k),
truth AS (SELECT DISTINCT user_id, item_id FROM val), n_truth AS (SELECT user_id, count(*) AS g FROM truth GROUP BY 1),
hits AS (
  SELECT t.user_id, rank, CASE WHEN v.item_id IS NULL THEN 0 ELSE 1 END AS hit, g
  FROM topk t JOIN n_truth n ON n.user_id = t.user_id LEFT JOIN truth v ON v.user_id = t.user_id AND v.item_id = t.item_id),
run AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY rank) AS so_far FROM hits),
per_user AS (
  SELECT user_id, k, sum(hit) AS h, count(*) AS n, sum(hit / log2(rank + 1)) AS dcg, sum(hit * so_far / rank) AS ap, max(g) AS g,
         (SELECT sum(1 / log2(r + 1)) FROM range(1, 51) x(r) WHERE r <= least(max(g), k)) AS idcg
  FROM run, ks WHERE rank <= k GROUP BY user_id, k)"""


def query(select: str, *steps: str) -> str:
    return f"WITH {', '.join(steps)}\n{select}"
