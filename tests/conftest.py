import os

import pytest

os.environ.setdefault("PYSPARK_PYTHON", __import__("sys").executable)


@pytest.fixture(scope="session")
def spark():
    from tidewell.session import build_session, ship_package

    session = build_session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
