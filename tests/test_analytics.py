import math
from datetime import datetime

import pytest

from brindle.functions import normal
from brindle.operators import churn, components, experiments, features, graph, interventions, metrics, ordered, ranking, reports, revenue


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_user_features(toy):
    f = by(features.user_features(toy), "user_id")
    u = f[11]
    assert (u["n_interactions"], u["n_items"], u["rating_mean"], u["active_days"], u["span_days"], u["days_since_last"]) == (4, 4, 3.5, 4, 7.0, 3.0)
    assert math.isclose(u["avg_gap_days"], 7 / 3) and u["median_gap_days"] == 2.0 and u["n_last_7d"] == 2
    assert f[12]["active_days"] == 2 and f[12]["median_gap_days"] == 1.5 and math.isclose(f[12]["rating_std"], math.sqrt(13 / 3))
    again = by(features.user_features(toy.unionByName(toy)), "user_id")
    assert (again[12]["n_interactions"], again[12]["n_items"], again[12]["active_days"]) == (6, 3, 2)


def test_single_row_user(spark):
    df = spark.createDataFrame([(1, 5, 2.0, datetime(2020, 1, 1))], "user_id long, item_id long, rating double, ts timestamp_ntz")
    r = features.user_features(df).first()
    assert (r["rating_std"], r["avg_gap_days"], r["median_gap_days"]) == (0.0, 0.0, 0.0)
    assert features.interaction_features(df).first()["rating_z_user"] == 0.0


def test_item_and_interaction_features(toy):
    i = by(features.item_features(toy), "item_id")
    assert (i[302]["n_users"], i[302]["rating_mean"], i[302]["days_since_last"], i[302]["n_last_7d"], i[302]["recent_share_30d"]) == (2, 4.25, 8.0, 0, 1.0)
    x = by(features.interaction_features(toy), "user_id", "item_id")
    assert math.isclose(x[12, 301]["rating_z_user"], (5 - 10 / 3) / math.sqrt(13 / 3)) and x[12, 301]["age_days"] == 9.0 and len(x) == 11


def test_graph(toy):
    cfg = graph.tuned(toy, graph.GraphConfig())
    assert (cfg.min_support, cfg.topk, cfg.min_cosine) == (1, 5, 0.0)
    e = by(graph.item_edges(toy, cfg), "src_item", "dst_item")
    assert e[301, 303]["cooc_cnt"] == 3 and math.isclose(e[301, 303]["cosine"], 1.0) and math.isclose(e[302, 301]["cosine"], 2 / math.sqrt(6)) and (304, 305) not in e
    assert all(0 <= r["cosine"] <= 1 for r in e.values()) and all((d, s) in e for s, d in e)
    top = graph.topk_neighbors(graph.item_edges(toy, cfg), 2).collect()
    assert max(r["rk"] for r in top) == 2 and len({(r["src_item"], r["rk"]) for r in top}) == len(top)


def test_norms_differ(toy):
    one = graph.GraphConfig(1, 1, 9, 0.0, 1, 3, "interactions", 0)
    e = by(graph.item_edges(toy, one), "src_item", "dst_item")  # two users have four items: out
    assert math.isclose(e[301, 303]["cosine"], 1 / 3) and (301, 302) not in e


def test_components(spark):
    pairs = [(1, 2), (2, 3), (7, 8), (9, 9), (20, 21), (21, 22), (22, 20), (22, 23)]
    df = spark.createDataFrame(pairs + [(i, i + 1) for i in range(100, 160)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df, "a", "b").collect()}
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 20: 20, 21: 20, 22: 20, 23: 20} | {i: 100 for i in range(100, 161)}
    assert got == want
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


def test_clusters(spark, toy):
    e = spark.createDataFrame([(1, 2, 0.5, 20), (2, 1, 0.5, 20), (5, 6, 0.5, 20), (6, 7, 0.5, 20), (8, 9, 0.01, 20)], "src_item long, dst_item long, cosine double, cooc_cnt long")
    got = {r["item_id"]: (r["cluster_id"], r["cluster_size"]) for r in components.connected_item_clusters(e, components.ClusterConfig(min_size=2)).collect()}
    assert got == {5: (0, 3), 6: (0, 3), 7: (0, 3), 1: (1, 2), 2: (1, 2)}
    assert {r["item_id"]: r["cluster_id"] for r in components.dense_item_clusters(toy).collect()} == {301 + i: i for i in range(6)}


def test_recommend(spark, toy):
    g = graph.item_edges(toy, graph.tuned(toy, graph.GraphConfig()))
    cfg = ranking.RankerConfig(k=3, min_history=2)
    top = ranking.recommend(toy, toy.limit(0), g, cfg).collect()
    assert all(r["rank"] <= 3 for r in top) and len({(r["user_id"], r["item_id"]) for r in top}) == len(top)
    seen = {(r["user_id"], r["item_id"]) for r in ranking.user_history(toy, cfg).collect()}
    assert not seen & {(r["user_id"], r["item_id"]) for r in top}
    pop = ranking.recommend(toy, toy.limit(0), None, cfg).collect()
    assert [r["item_id"] for r in sorted(pop, key=lambda r: (r["user_id"], r["rank"]))[:3]] == [301, 303, 302]
    few = ranking.recommend(toy, toy.limit(0), g, ranking.RankerConfig(k=3, min_history=9)).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, pop))


def test_exclude_seen(toy):
    top = ranking.recommend(toy, toy.limit(0), None, ranking.RankerConfig(k=9, exclude_seen=True))
    assert top.join(toy, ["user_id", "item_id"]).count() == 0


def test_metrics(spark):
    recs = spark.createDataFrame([(1, i, r) for r, i in enumerate([5, 6, 7], 1)] + [(2, 9, 1)], "user_id long, item_id long, rank int")
    truth = spark.createDataFrame([(1, 6), (1, 7), (1, 6), (3, 1), (2, 1)], "user_id long, item_id long")
    m = by(metrics.evaluate_topk(recs, truth, (2, 5)), "k")
    ndcg = (1 / math.log2(3)) / (1 + 1 / math.log2(3))
    assert m[2]["n_users_eval"] == 2 and math.isclose(m[2]["precision"], 0.25) and math.isclose(m[2]["recall"], 0.25) and m[2]["hit_rate"] == 0.5
    assert math.isclose(m[2]["ndcg"], ndcg / 2) and math.isclose(m[2]["map"], 0.25 / 2)
    assert math.isclose(m[5]["precision"], (2 / 3) / 2)
    fixed = by(metrics.evaluate_topk(recs, truth, (2, 5), fixed_k=True), "k")
    assert math.isclose(fixed[5]["precision"], 0.4 / 2)
    none = by(metrics.evaluate_topk(recs, truth.limit(0), (2,)), "k")
    assert none[2]["n_users_eval"] == 0 and none[2]["map"] == 0.0
    assert metrics.as_report(metrics.evaluate_topk(recs, truth, (2,)))["hit_rate@2"] == 0.5


def test_auc(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 1), (0.1, 0)]
    df = spark.createDataFrame(rows, "churn_prob double, label int")
    pairs = [(p > n) + 0.5 * (p == n) for p, a in rows for n, b in rows if a == 1 and b == 0]
    r = churn.auc(df).first()
    assert math.isclose(r["roc_auc"], sum(pairs) / len(pairs)) and 0 < r["pr_auc"] <= 1 and r["churn_rate"] == 0.5
    assert churn.auc(df.where("label = 1")).first()["roc_auc"] is None


def test_pr_auc(spark):
    """Trapezoids over the curve, ties together."""
    rows = [(0.9, 1), (0.7, 0), (0.7, 1), (0.7, 1), (0.2, 0), (0.1, 1)]
    curve, area = [(0.0, 1.0)], 0.0
    for cut in (0.9, 0.7, 0.2, 0.1):
        got = [y for s, y in rows if s >= cut]
        curve.append((sum(got) / 4, sum(got) / len(got)))
        (r0, p0), (r1, p1) = curve[-2:]
        area += (r1 - r0) * (p0 + p1) / 2
    assert math.isclose(churn.auc(spark.createDataFrame(rows, "churn_prob double, label int")).first()["pr_auc"], area)


def test_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(float(rng.integers(0, 9)), None if i % 5 == 0 else float(x)) for i, x in enumerate(rng.normal(size=101))]
    df = spark.createDataFrame(rows, "a double, b double").repartition(7)
    want = {"a2": ("a", 0.2), "a5": ("a", 0.5), "b9": ("b", 0.9), "b0": ("b", 0.0), "b1": ("b", 1.0)}
    got = ordered.quantiles(df, want)
    for name, (c, q) in want.items():
        assert math.isclose(got[name], np.quantile([r[c == "b"] for r in rows if r[c == "b"] is not None], q), abs_tol=1e-12)
    assert ordered.quantiles(df.limit(0), {"x": ("a", 0.5)}) == {"x": None}


def test_running_totals(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(50)], "k int, a int, b int").repartition(6)
    got = {r["k"]: (r["x"], r["y"]) for r in ordered.running_totals(df, "k", x=F.col("a"), y=F.col("b")).collect()}
    assert got == {i: (sum(j % 3 for j in range(i + 1)), sum(j % 2 for j in range(i + 1))) for i in range(50)}


def test_two_sided_p(spark):
    from pyspark.sql import functions as F

    from brindle.functions.columns import two_sided_p

    rows = spark.range(-40, 41).select((F.col("id") / 10.0).alias("z")).select("z", two_sided_p(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - normal.two_sided_p(r["z"])) < 2e-7 for r in rows)


def test_seed_and_clock():
    import random

    from brindle.functions import runtime

    runtime.set_seed(5)
    a = random.random()
    runtime.set_seed(5)
    assert a == random.random() and runtime.utc_now().utcoffset().total_seconds() == 0


def test_churn_model(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    n = 200
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=n) > 0.4).astype(int)
    f = spark.createDataFrame([(i, float(a), float(b) if i % 9 else None) for i, (a, b) in enumerate(x)], "user_id long, f1 double, f2 double")
    lab = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "user_id long, label int")
    scored, report = churn.train_and_score(f, lab)
    got = scored.orderBy("user_id").toPandas()
    val = got[got["part"] == "val"]
    wins = [(p > n) + 0.5 * (p == n) for p in val[val["label"] == 1]["churn_prob"] for n in val[val["label"] == 0]["churn_prob"]]
    assert math.isclose(report["roc_auc"], np.mean(wins)) and math.isclose(report["churn_rate"], y.mean()) and 0 < report["pr_auc"] <= 1
    assert report["n_features"] == 2 and (got["part"] == "train").sum() == 160 and got["churn_prob"].between(0, 1).all()
    # The same objective by Newton's method.
    z = np.array([[a, b if i % 9 else np.nan] for i, (a, b) in enumerate(x)])
    t = z[:160]
    z = np.where(np.isnan(z), np.nanmedian(t, axis=0), z)
    t = z[:160]
    z = (z - t.mean(0)) / t.std(0)
    d = np.column_stack([z, np.ones(n)])
    tr, yt = d[:160], y[:160]
    w8 = np.where(yt == 1, 160 / (2 * yt.sum()), 160 / (2 * (160 - yt.sum())))
    w = np.zeros(3)
    pen = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-tr @ w))
        w -= np.linalg.solve((tr * (w8 * p * (1 - p))[:, None]).T @ tr + pen, tr.T @ (w8 * (p - yt)) + pen @ w)
    assert np.allclose(got["churn_prob"], 1 / (1 + np.exp(-d @ w)), atol=1e-4)


def test_two_classes(spark, toy):
    with pytest.raises(ValueError):
        churn.two_class_labels(toy.where("user_id = 12"))
    assert {r["label"] for r in churn.two_class_labels(toy).collect()} == {0, 1}


def test_feature_columns(toy):
    f = features.user_features(toy)
    assert len(churn.feature_columns(f)) == 14 and "days_since_last" not in churn.feature_columns(f, churn.ChurnConfig(exclude_recency=True))


def test_ltv_and_risk(spark, toy):
    ltv = by(revenue.user_ltv(toy), "user_id")
    months = round(2 + 1.2 * math.log(4) + 0.8 * math.log(4) - 0.08 * 6)
    assert ltv[12]["expected_months"] == months and math.isclose(ltv[12]["ltv_usd"], 15.49 * months)
    scores = spark.createDataFrame([(11, 0.9), (12, 0.1), (13, 0.5)], "user_id long, churn_prob double")
    risk = revenue.revenue_risk(scores, revenue.user_ltv(toy))
    r = by(risk, "user_id")
    assert math.isclose(r[11]["revenue_at_risk_usd"], 0.9 * r[11]["ltv_usd"]) and r[12]["risk_bucket"] == "low" and r[11]["risk_bucket"] == "high"
    top = revenue.revenue_risk_top(risk, revenue.LtvConfig(top_share=0.5)).collect()
    assert [(t["user_id"], t["rn"], t["n"]) for t in sorted(top, key=lambda t: t["rn"])] == [(11, 1, 3), (13, 2, 3)]
    assert revenue.revenue_risk_summary(risk).first()["n_users"] == 3
    with pytest.raises(ValueError):
        revenue.revenue_risk(scores.withColumnRenamed("churn_prob", "x"), revenue.user_ltv(toy))


def test_interventions(spark):
    rows = [(1, 0.9, 371.0), (2, 0.9, 371.0), (3, 0.8, 15.49), (4, 0.5, 100.0), (5, 0.1, 100.0), (6, 0.95, 15.0)]
    risk = spark.createDataFrame([(u, p, v, p * v) for u, p, v in rows], "user_id long, p_churn double, ltv_usd double, revenue_at_risk_usd double")
    cfg = interventions.InterventionConfig(cap_discount=1)
    pol = by(interventions.initial_policy(risk, cfg), "user_id")
    assert [pol[u]["intervention"] for u in range(1, 7)] == ["discount_2mo", "none", "content_boost", "email_nudge", "none", "content_boost"]
    out = by(interventions.simulate_interventions(risk, cfg), "user_id")
    assert math.isclose(out[1]["p_churn_new"], 0.63, rel_tol=1e-6) and math.isclose(out[1]["intervention_cost_usd"], 0.2 * 15.49 * 2, rel_tol=1e-6)
    strict = by(interventions.simulate_interventions(risk, interventions.InterventionConfig(margin=100.0)), "user_id")
    assert strict[1]["intervention"] == "content_boost" and strict[1]["intervention_cost_usd"] == 0.0
    s = interventions.intervention_summary(interventions.simulate_interventions(risk, cfg)).first().asDict()
    assert len(s) == 14 and s["n_discount_2mo"] == 1
    assert "n_users" in reports.intervention_markdown(s)


def test_experiment(spark, toy):
    users = spark.range(4000).withColumnRenamed("id", "user_id")
    share = {r["variant"]: r["count"] / 4000 for r in experiments.assign_variants_3arm(users).groupBy("variant").count().collect()}
    assert abs(share["content"] - 0.45) < 0.04 and abs(share["discount"] - 0.05) < 0.02
    import hashlib

    u = int(hashlib.sha256(b"retention_ab:7").hexdigest()[:16], 16) % 10**12 / 1e12
    got = {r["user_id"]: r["variant"] for r in experiments.assign_variants(users.limit(10)).collect()}
    assert got[7] == ("treatment" if u < 0.5 else "control")
    assert experiments.required_sample_size(10, 5) == math.ceil(2 * ((1.959963984540054 + 0.8416212335729143) * 5 / 0.3) ** 2)
    with pytest.raises(ValueError):
        experiments.required_sample_size(0, 1)
    assert math.isclose(normal.two_sided_p(1.959963984540054), 0.05, rel_tol=1e-9)
    z = experiments.ztest(10, 4, 100, 11, 4, 100)
    assert math.isclose(z["z"], 1 / math.sqrt(0.08)) and math.isclose(z["lift"], 0.1)
    assert math.isnan(experiments.ztest(1, 0, 5, 1, 0, 5)["z"])


def test_experiment_report(spark):
    from pyspark.sql import functions as F

    risk = spark.range(300).select(F.col("id").alias("user_id"), (F.col("id") % 10 / 10).alias("p_churn"), (F.col("id") % 7 * 15.49).alias("ltv_usd")).withColumn("revenue_at_risk_usd", F.col("p_churn") * F.col("ltv_usd"))
    done = interventions.simulate_interventions(risk).where("user_id % 2 = 0")
    r = experiments.experiment_report(risk, done)
    assert r["n_total"] == 300 and sum(r["counts"].values()) == 300 and r["arm_net_value"]["control"] == 0.0
    assert "content" in reports.experiment_markdown(r)


def test_reports(spark, toy):
    e = spark.createDataFrame([(1, 2, 0.5, 3), (2, 1, 0.5, 3), (1, 3, 1.0, 7)], "src_item long, dst_item long, cosine double, cooc_cnt long")
    assert sorted(map(tuple, reports.cosine_against_cooccurrence(e, 10).collect())) == [(3, 5, 2), (7, 9, 1)]
    bars = reports.arm_bars(spark.createDataFrame([("control", 4, 10.0, 16.0)], "variant string, n long, mean_y double, var_y double")).first()
    assert math.isclose(bars["hi"] - bars["lo"], 2 * 1.959963984540054 * 2)
    h = reports.histogram(toy, "rating", 3).orderBy("bin").collect()
    assert [(r["bin"], r["n"]) for r in h] == [(0, 2), (1, 2), (2, 7)] and h[-1]["hi"] == 5.0
    assert reports.plot_sample(toy, "item_id", 3).count() == 3
    t = reports.summary_table({"a": toy.agg({"rating": "max"}).toDF("top")}).first()
    assert tuple(t) == ("a", "top", 5.0)
