import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            c.sql(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return c


def plain(value):
    """A value as text that is the same for Spark's and DuckDB's rows."""
    if value is None or value != value:
        return None
    if isinstance(value, float):
        value = round(value, 6)
        return str(int(value)) if value == int(value) else str(value)
    return str(value)


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame has the rows and columns that SQL gives."""

    def check(df, sql):
        got = df.toPandas()
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        cols = sorted(got.columns)
        a = sorted([tuple(map(plain, r)) for r in got[cols].astype(object).where(got[cols].notna(), None).itertuples(index=False)], key=repr)
        b = sorted([tuple(map(plain, r)) for r in want[cols].astype(object).where(want[cols].notna(), None).itertuples(index=False)], key=repr)
        assert len(a) == len(b)
        assert a == b

    return check
