"""Every query that has SQL gives what DuckDB gives for it, on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from stratalog.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROWS_ONLY = set(QUERIES) - set(ORACLES)


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return round(float(v), 5)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(QUERIES) > 150


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    want = sorted(repr([value(r[columns.index(c)]) for c in order]) for r in cursor.fetchall())
    assert sorted(repr([value(r[c]) for c in order]) for r in got.collect()) == want
    assert want or name in ("orphans", "stale_cascade", "list_pending", "stale_ids", "gone_reviews", "cycles", "propose_change", "open_merge_hints")


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
