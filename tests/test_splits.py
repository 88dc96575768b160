import pytest

from brindle.operators import splits
from brindle.schema import canonicalize, check_schema, validate_interactions


def counts(df):
    return {(r["user_id"], r["split"]): r["count"] for r in df.groupBy("user_id", "split").count().collect()}


def test_per_user(two_users):
    assert counts(splits.split_per_user(two_users)) == {(21, "train"): 8, (21, "val"): 2, (21, "test"): 2, (22, "train"): 3}


def test_per_user_shares(two_users):
    got = counts(splits.split_per_user(two_users, splits.SplitConfig(0.5, 0.3, 4)))
    assert got == {(21, "train"): 6, (21, "val"): 3, (21, "test"): 3, (22, "train"): 3}


def test_small_users_are_all_train(toy):
    assert {k[1] for k in counts(splits.split_per_user(toy))} == {"train"}


def test_global_order(two_users):
    out = splits.split_global(two_users).collect()
    last = {s: max(r["ts"] for r in out if r["split"] == s) for s in ("train", "val")}
    first = {s: min(r["ts"] for r in out if r["split"] == s) for s in ("val", "test")}
    assert [sum(r["split"] == s for r in out) for s in ("train", "val", "test")] == [10, 2, 3]
    assert last["train"] <= first["val"] and last["val"] <= first["test"]


@pytest.mark.parametrize("t,v", [(0.7, 0.3), (1.5, 0.1), (0.6, -0.05), (0.55, 0.5)])
def test_bad_shares(t, v):
    with pytest.raises(ValueError):
        splits.SplitConfig(t, v)


def test_bad_minimum():
    with pytest.raises(ValueError):
        splits.SplitConfig(min_interactions=0)


def test_overlaps(two_users):
    from pyspark.sql import functions as F

    good = splits.split_per_user(two_users)
    assert splits.overlaps(good).count() == 0
    twice = good.unionByName(good.where("user_id = 22").withColumn("split", F.lit("test")))
    assert {(r["user_id"], r["n_splits"]) for r in splits.overlaps(twice).collect()} == {(22, 2)}


def test_empty(spark, toy):
    none = toy.limit(0)
    assert splits.split_per_user(none).count() == 0 and splits.split_global(none).count() == 0
    m = splits.split_metadata(splits.split_per_user(none)).first().asDict()
    assert m["n_total"] == 0 and m["frac_train"] == 0.0


def test_no_leakage_and_detection(two_users):
    good = splits.split_per_user(two_users)
    assert splits.leakage_violations(good).count() == 0
    splits.validate_per_user_order(good)
    from pyspark.sql import functions as F

    bad = good.withColumn("split", F.when(F.col("split") == "train", "test").when(F.col("split") == "test", "train").otherwise("val"))
    assert splits.leakage_violations(bad).count() == 1
    with pytest.raises(ValueError):
        splits.validate_per_user_order(bad)
    skipping = bad.where("split <> 'val'")
    assert splits.leakage_violations(skipping).count() == 0 and splits.order_violations(skipping).count() == 1


def test_deterministic(two_users):
    a, b = (sorted(map(tuple, splits.split_per_user(two_users).collect())) for _ in range(2))
    assert a == b


def test_validation(spark, toy):
    validate_interactions(toy)
    with pytest.raises(ValueError):
        check_schema(toy.drop("rating"))
    with pytest.raises(ValueError):
        check_schema(toy.withColumn("ts", toy["ts"].cast("string")))
    with pytest.raises(ValueError):
        validate_interactions(toy.withColumn("rating", -toy["rating"]))
    with pytest.raises(ValueError):
        canonicalize(toy.drop("user_id"))


def test_canonical_epoch(spark):
    df = spark.createDataFrame([(1, 2, 3, 86400)], "user_id int, item_id int, rating int, timestamp long")
    r = canonicalize(df).first()
    assert (r["rating"], str(r["ts"])) == (3.0, "1970-01-02 00:00:00")
