import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from gridloom.session import session

    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false"})
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def comparable(value):
    """A value as both engines would print it."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(map(comparable, value))
    return str(value)


@pytest.fixture(scope="session")
def same(spark, duck, data):
    """Asserts that a query and its SQL give the same rows."""

    def check(query, sql):
        df = query(spark, data)
        names = sorted(df.columns)
        own = sorted(repr(tuple(map(comparable, r))) for r in df.select(*names).collect())
        cursor = duck.execute(sql)
        there = [x[0] for x in cursor.description]
        assert sorted(there) == names
        order = [there.index(n) for n in names]
        assert own == sorted(repr(tuple(comparable(r[k]) for k in order)) for r in cursor.fetchall())

    return check
