"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from tidemark import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        made.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return made


def plain(value):
    return round(float(value), 9) if isinstance(value, float | Decimal) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(row[i]) for i in places) for row in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["symbol", "sessions", "last_session", "last_close", "one_day_return"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
