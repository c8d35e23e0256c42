import os

import pytest

from regionlab.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql_agrees(spark, tiny, name):
    """The queries against their SQL on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(tiny):
        con.execute(f"create view {f[:-8]} as select * from '{tiny}/{f}'")
    df = q.QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))
    res = con.execute(q.SQL[name])
    at = {d[0]: i for i, d in enumerate(res.description)}
    assert got == sorted(map(repr, (tuple(r[at[c]] for c in cols) for r in res.fetchall())))
