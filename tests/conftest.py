import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import build_session

    session = build_session(
        "local[4]", "tests",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")), "spark.driver.host": "127.0.0.1",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """SQL over the smallest tables, for what queries are checked against."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in os.listdir(folder):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{folder}/{name}')")
    return con, folder
