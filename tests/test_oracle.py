"""Every query of the engine against its SQL on DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from linkweave.plans.oracle import SQL
from linkweave.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def _plain(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((_plain(r) for r in df.select(*columns).collect()), key=repr)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    theirs = sorted((_plain(r) for r in rel.select(*columns).fetchall()), key=repr)
    assert ours == theirs
