"""Every query with SQL gives what DuckDB gives for that SQL on the same tables."""

import math

import duckdb
import pytest

from sparkroost import catalogue
from sparkroost.plans.views import TABLES
from tests.conftest import DATA


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(round(float(v), 5))
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, DATA).toPandas()
    theirs = duck.execute(catalogue.ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
