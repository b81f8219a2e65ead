import pytest

from marginalia.session import importable, session


@pytest.fixture(scope="session")
def spark():
    s = session(
        "tests", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield importable(s)
    s.stop()
