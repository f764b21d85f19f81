"""Every query with SQL beside it gives the same rows as DuckDB on the smallest tables."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from tallyforge import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def same(v):
    return round(float(v), 6) if isinstance(v, (float, Decimal)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(same(v) for v in r) for r in df.select(cols).collect()), key=repr)
    res = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in res.description]
    want = sorted((tuple(same(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert sorted(names) == cols and got == want


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == queries.ORACLES.keys()


def test_all_sql_is_text():
    import __spark_entry__ as entry

    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    row = entry.entry(spark).first()
    assert row.relationship == "一对多" and row.row_amplified
