"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from sieveloom.plans import checks, forms, language, prep, training

D = "/root/testdata/sf0.001"
ALL = {n: (f, m.SQL[n]) for m in (language, checks, prep, training, forms) for n, f in m.QUERIES.items() if n in m.SQL}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(D):
        p = f"{D}/{f}" + ("/*.parquet" if os.path.isdir(f"{D}/{f}") else "")
        c.execute(f"CREATE VIEW \"{f.split('.')[0]}\" AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_equals_sql(spark, duck, name):
    f, sql = ALL[name]
    df = f(spark, D)
    cols = sorted(df.columns)
    cur = duck.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())
