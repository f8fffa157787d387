"""Corpus queries with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from cresthaven.llm import corpus_queries as Q

D = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet{'/*.parquet' if __import__('os').path.isdir(f'{D}/{t}.parquet') else ''}'")
    cur = c.execute(Q.SQL[name])
    names = [x[0] for x in cur.description]
    df = getattr(Q, name)(spark, D)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(x)]) for x in order) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[x]) for x in order) for r in df.collect()), key=repr)
    assert len(got) == len(want) and [g for g in got if g not in set(want)][:2] == [w for w in want if w not in set(got)][:2]
