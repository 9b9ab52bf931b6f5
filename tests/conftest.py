"""One local session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    place = tmp_path_factory.mktemp("spark")
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
        "spark.local.dir": str(place / "local"), "spark.sql.warehouse.dir": str(place / "warehouse"), "spark.checkpoint.dir": f"file://{place}/shared", "spark.python.worker.faulthandler.enabled": "true",
    }
    session = SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[4]")).config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    """A value in a form in which Spark's and DuckDB's results can be compared."""
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


@pytest.fixture(scope="session")
def same():
    """Compares a DataFrame with a DuckDB result, as multisets of rows with columns in order of name."""

    def compare(df, result):
        names = [c[0] for c in result.description]
        columns = sorted(df.columns)
        assert sorted(names) == columns
        theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
        ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
        assert ours == theirs

    return compare
