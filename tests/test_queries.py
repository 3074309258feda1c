"""Every query outside the optional subpackage over the smallest tables, against its SQL where it has one."""

from pathlib import Path

import pandas as pd
import pytest

from tideline.plans import events, files, items, learning, pipelines, ranking, recall, training

FOLDER = Path("/root/testdata/sf0.001")
MODULES = [training, events, recall, ranking, items, learning, pipelines, files]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the test tables aren't here")


@pytest.fixture(scope="module", autouse=True)
def stock(spark):
    """Arrow conversion off, as in a session without settings of its own."""
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    yield
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(frame):
    missing = lambda x: x is None or x is pd.NA or x != x
    number = lambda x: isinstance(x, (int, float)) or type(x).__module__ == "numpy"
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(None if missing(x) else round(float(x), 6) if number(x) else str(x) for x in row)) for row in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    frame = QUERIES[name](spark, str(FOLDER)).toPandas()
    if name in ORACLES:
        want = con.execute(ORACLES[name]).df()
        assert sorted(frame.columns) == sorted(want.columns)
        assert plain(frame) == plain(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
