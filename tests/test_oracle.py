"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import pytest

from folio.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return round(v, 5) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, DATA)
    r = con.execute(SQL[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = sorted((tuple(_plain(x[i]) for i in order) for x in r.fetchall()), key=repr)
    assert sorted((tuple(map(_plain, x)) for x in df.collect()), key=repr) == want
