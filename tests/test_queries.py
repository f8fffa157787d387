"""Every query with SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from cresthaven.plans import catalog

D = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


def canon(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return str(v)
        return repr(float(v))

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = canon(tuple(r[names.index(c)] for c in order) for r in cur.fetchall())
    got = canon(tuple(r[c] for c in order) for r in df.collect())
    assert got == want
