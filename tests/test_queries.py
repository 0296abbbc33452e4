"""Every query with SQL against DuckDB, as the driver compares them; the contract functions."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from barwright.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cur = duck.execute(ORACLE_SQL[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == columns
    want = [tuple(r[at[c]] for c in columns) for r in cur.fetchall()]
    got = [tuple(r) for r in df.select(columns).collect()]
    order = lambda r: tuple(str(x) for x in r if not isinstance(x, float)) + tuple(str(round(x, 3)) for x in r if isinstance(x, float))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert all(map(same, a, b)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
