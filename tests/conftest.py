import pytest

from aerostrata import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "tests",
        {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
         "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
