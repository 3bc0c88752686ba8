"""Every registered query with SQL gives the same values as DuckDB on the small tables."""

import datetime as dt

import duckdb
import pytest

from stakeflow.plans import QUERIES
from stakeflow.sources.tables import RAW

from .conftest import SF

NAMES = [name for name, q in QUERIES.items() if q.sql]


def norm(v):
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in RAW:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    q = QUERIES[name]
    df = q(spark, SF)
    cur = con.execute(q.sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got, want = table(df.columns, df.collect()), table(cols, cur.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=2e-5) if all(isinstance(x, float) for x in g) else _close(g, w)


def _close(g, w):
    return all(abs(a - b) <= 2e-5 if isinstance(a, float) and isinstance(b, float) else a == b for a, b in zip(g, w))


def test_entry_contract(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
