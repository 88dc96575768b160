from pathlib import Path

from brindle import scratch
from brindle.operators import splits
from brindle.schema import INTERACTIONS
from brindle.sources import io
from brindle.streaming.ingest import ingest_ratings


def write_csv(path, rows):
    path.mkdir(exist_ok=True)
    (path / f"part{len(list(path.iterdir()))}.csv").write_text("userId,movieId,rating,timestamp\n" + "".join(f"{u},{i},{r},{t}\n" for u, i, r, t in rows))


def test_csv_round_trip(spark, tmp_path):
    write_csv(tmp_path / "in", [(1, 2, 3.5, 0), (1, 3, 4.0, 86400)])
    df = io.read_ratings_csv(spark, str(tmp_path / "in"))
    assert df.schema == INTERACTIONS
    io.write_parquet(df, str(tmp_path / "out"), order_by=("user_id", "item_id"), files=1)
    back = io.read_parquet(spark, str(tmp_path / "out"), "item_id", "ts").collect()
    assert sorted((r["item_id"], str(r["ts"])) for r in back) == [(2, "1970-01-01 00:00:00"), (3, "1970-01-02 00:00:00")]


def test_optional(spark, tmp_path):
    assert io.read_optional(spark, str(tmp_path / "none"), INTERACTIONS).count() == 0


def test_json(spark, tmp_path):
    for path in (str(tmp_path / "x" / "y.json"), f"file://{tmp_path}/z/y.json"):
        io.write_json(spark, {"b": 1, "a": [2]}, path)
        io.write_json(spark, {"b": 1, "a": [2, "é"]}, path)
        assert io.read_json(spark, path) == {"a": [2, "é"], "b": 1}
    assert not (tmp_path / "file:").exists()


def test_splits_and_metadata(spark, tmp_path, two_users):
    rows = splits.split_per_user(two_users)
    io.write_splits(rows, f"file://{tmp_path}/splits", splits.split_metadata(rows).first().asDict())
    assert {p.name for p in (tmp_path / "splits").glob("split=*")} == {"split=train", "split=val", "split=test"}
    assert io.read_json(spark, f"{tmp_path}/splits.metadata.json")["n_train"] == 11 and spark.read.parquet(f"{tmp_path}/splits").count() == 15


def test_ratings_csv(spark, tmp_path, toy):
    io.write_ratings_csv(toy, str(tmp_path / "raw"))
    assert sorted(map(tuple, io.read_ratings_csv(spark, str(tmp_path / "raw")).collect())) == sorted(map(tuple, toy.collect()))


def test_ordered_sink(spark, tmp_path, toy):
    io.write_parquet(toy, str(tmp_path / "o"), order_by=("item_id", "user_id"), files=1)
    got = [(r["item_id"], r["user_id"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()]
    assert got == sorted(got) and len(list((tmp_path / "o").glob("*.parquet"))) == 1


def test_scope(spark, toy):
    with scratch.scope(spark):
        made = scratch.materialize(toy, "inside")
        assert made.count() == 11
        folder = made.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert Path(folder).is_dir()
    assert not Path(folder).exists() and scratch.materialize(toy, "outside").count() == 11


def test_stream_reads_each_file_once(spark, tmp_path):
    write_csv(tmp_path / "in", [(1, 2, 3.5, 0)])
    go = lambda: ingest_ratings(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    write_csv(tmp_path / "in", [(2, 2, 1.0, 10)])
    go()
    go()
    assert sorted(r["user_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
