"""Every query with SQL against DuckDB, on the smallest tables; the others must run and keep their schema."""

import datetime as dt
import os
from collections import Counter

import pytest

from palimpsest.plans import catalog

FOLDER = os.environ.get("PALIMPSEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 6)
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)
    return value


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = Counter(tuple(plain(v) for v in r) for r in frame.select(*columns).collect())
    result = duck.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    frame = catalog.QUERIES[name](spark, FOLDER)
    assert len(frame.columns) == len(set(frame.columns)) and frame.count() >= 0
