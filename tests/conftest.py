import glob
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from leafmill.session import ship_package

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "~" if x != x else repr(round(x, 9) + 0.0)
    if isinstance(x, (list, tuple)):
        return str([_plain(i) for i in x])
    return "~" if x is None else str(x)


@pytest.fixture(scope="session")
def same_rows(duck):
    """Asserts that a DataFrame and a DuckDB query have the same columns and rows."""

    def check(df, sql):
        got = duck.execute(sql)
        names = [d[0] for d in got.description]
        want = got.fetchall()
        cols = sorted(df.columns)
        assert cols == sorted(names)
        at = [names.index(c) for c in cols]
        have = sorted([_plain(r[c]) for c in cols] for r in df.collect())
        assert have == sorted([_plain(r[i]) for i in at] for r in want)

    return check
