"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
OWN = [n for part in entry.PARTS for n in part.QUERIES]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    return round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=str)
    want = sorted((tuple(map(plain, r)) for r in db.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({sql})").fetchall()), key=str)
    assert got == want
