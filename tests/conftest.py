import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trackloom.session import build_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "trackloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name[:-8]} as select * from '{FOLDER}/{name}'")
    return con


@pytest.fixture
def small_blocks(spark):
    """Force the multi-block paths of the ordered operators."""
    spark.conf.set("trackloom.rowsPerBlock", "50")
    yield
    spark.conf.unset("trackloom.rowsPerBlock")
