"""Registered queries run at the smallest scale and have the columns of their SQL."""

import os

import duckdb
import pytest

from foliospark.plans.oracle import SQL
from foliospark.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return db


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = con.sql(SQL[name])
    assert sorted(expected.columns) == columns
    norm = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    got = sorted([norm(r[c]) for c in columns] for r in df.collect())
    want = sorted([norm(x) for x in r] for r in con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall())
    assert got == want


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)
