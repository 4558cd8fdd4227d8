"""The driver's contract, and the SQL twins at the scale and the decimals that it compares."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from flowloom.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
TABLES = ["events", "lineitem", "conversations", "orders"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(rows):
    def cell(v):
        return round(float(v), 6) if isinstance(v, float) else v

    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    other = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    assert norm(map(tuple, df.select(*columns).collect())) == norm(other.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
