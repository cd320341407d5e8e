"""Every query with SQL gives the same rows in DuckDB at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__
from gaitspark.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.execute(registry.ORACLES[name])
    have = [d[0] for d in want.description]
    assert sorted(have) == names
    rows = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[have.index(c)]) for c in names) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
