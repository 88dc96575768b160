import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from brindle.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"{shared}/warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def toy(spark):
    """Eleven interactions of three users with six items, in eleven days."""
    days = {11: [(301, 2.0, 1), (302, 4.0, 3), (303, 4.5, 4), (304, 3.5, 8)], 12: [(301, 5.0, 2), (303, 4.0, 2), (305, 1.0, 5)], 13: [(302, 4.5, 1), (303, 3.0, 6), (306, 5.0, 10), (301, 4.0, 11)]}
    rows = [(u, i, r, datetime(2021, 3, d)) for u, own in days.items() for i, r, d in own]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts timestamp_ntz").cache()


@pytest.fixture(scope="session")
def two_users(spark):
    """A user with a row a day for twelve days, and one with three rows in a later year."""
    rows = [(21, 7 * i, 1.0 + i % 4, datetime(2019, 5, 1 + i)) for i in range(12)] + [(22, 900 - i, 2.5, datetime(2022, 2, 3 + 2 * i)) for i in range(3)]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts timestamp_ntz").cache()
