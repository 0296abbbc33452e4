"""Registered queries against their SQL, as the driver compares them."""

import duckdb
import pytest

from barwright.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    cursor = con.execute(ORACLE_SQL[name])
    assert sorted(d[0] for d in cursor.description) == columns
    places = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in places) for r in cursor.fetchall()), key=str)
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == want
