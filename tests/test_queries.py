"""Every registered query runs on the smallest tables; those with SQL equal DuckDB's result."""

import glob
import os

import duckdb
import pytest

from casebolt.queries import Q


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: round(float(v), 4) if isinstance(v, float) else v
    return sorted([str(one(r[i])) for i in order] for r in values)


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, sf, duck, name):
    f, sql = Q[name]
    df = f(spark, sf)
    got = [tuple(r) for r in df.collect()]
    if sql:
        r = duck.execute(sql)
        columns = [x[0] for x in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(got, df.columns) == rows(r.fetchall(), columns)
