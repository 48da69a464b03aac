"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ringfold.plans import inventory, tpch

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([repr(r[i]) for i in order] for r in data))


@pytest.mark.parametrize("name", [*tpch.SQL, *inventory.SQL])
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in df.collect()])
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = rows(columns, [tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in found.fetchall()])
    assert sorted(df.columns) == sorted(columns)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
