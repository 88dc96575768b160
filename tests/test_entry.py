import __spark_entry__ as e


def test_catalog_names():
    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 45


def test_entry_is_lazy_and_has_rows(spark, tmp_path):
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    df = e.entry(spark)
    assert df.columns == ["user_id", "item_id", "score", "rank"] and df.limit(1).count() == 1
