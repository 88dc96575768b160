"""The stages wired together: interactions in, every artifact out, as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from brindle.operators import churn, components, experiments, features, graph, interventions, metrics, ranking, revenue, splits
from brindle.schema import canonicalize, validate_interactions
from brindle.scratch import materialize
from brindle.sources.io import write_parquet


@dataclass(frozen=True)
class PipelineConfig:
    split: splits.SplitConfig = field(default_factory=splits.SplitConfig)
    features: features.FeatureConfig = field(default_factory=features.FeatureConfig)
    graph: graph.GraphConfig = field(default_factory=graph.GraphConfig)
    clusters: components.ClusterConfig = field(default_factory=components.ClusterConfig)
    ranker: ranking.RankerConfig = field(default_factory=ranking.RankerConfig)
    churn: churn.ChurnConfig = field(default_factory=churn.ChurnConfig)
    ltv: revenue.LtvConfig = field(default_factory=revenue.LtvConfig)
    interventions: interventions.InterventionConfig = field(default_factory=interventions.InterventionConfig)
    experiment: experiments.ExperimentConfig = field(default_factory=experiments.ExperimentConfig)


def run(interactions: DataFrame, cfg: PipelineConfig = PipelineConfig(), out: str | None = None) -> dict[str, DataFrame]:
    """Every table of the pipeline by name; written below ``out`` where that is given.

    The labeled interactions, the graph and the scores are stored once, as several stages read them.
    """
    rows = canonicalize(interactions)
    validate_interactions(rows)
    labeled = materialize(splits.split_per_user(rows, cfg.split), "labeled")
    splits.validate_per_user_order(labeled)
    train, val, test = splits.splits(labeled)
    t = {"split_metadata": splits.split_metadata(labeled), "user_features": features.user_features(train, cfg.features), "item_features": features.item_features(train, cfg.features), "interaction_features": features.interaction_features(train)}
    t["item_graph"] = materialize(graph.build_graph(train, cfg.graph), "graph")
    t["item_clusters"] = components.connected_item_clusters(t["item_graph"], cfg.clusters)
    t["topk"] = materialize(ranking.recommend(train, val, t["item_graph"], cfg.ranker), "topk")
    t["ranking_metrics"] = metrics.evaluate_topk(t["topk"], val)
    scored, _ = churn.train_and_score(t["user_features"], churn.two_class_labels(train, cfg.churn), cfg.churn)
    t["churn_scores"] = materialize(scored, "churn")
    t["user_ltv"] = revenue.user_ltv(train, cfg.ltv)
    t["user_risk"] = materialize(revenue.revenue_risk(t["churn_scores"].select("user_id", "churn_prob"), t["user_ltv"]), "risk")
    t["user_risk_top"] = revenue.revenue_risk_top(t["user_risk"], cfg.ltv)
    t["interventions"] = materialize(interventions.simulate_interventions(t["user_risk"], cfg.interventions), "interventions")
    t["experiment"] = experiments.arm_stats(experiments.observed(experiments.outcomes(t["user_risk"], t["interventions"]), cfg.experiment))
    t["labeled"] = labeled
    if out:
        for name, df in t.items():
            write_parquet(df, f"{out}/{name}", partition_by=("split",) if name == "labeled" else ())
    return t
