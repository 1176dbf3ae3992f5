"""Every query that has an SQL twin against DuckDB."""

import decimal

import duckdb
import pytest

import __spark_entry__
from tidemark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def in_order(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, db, small, name):
    df = catalog.QUERIES[name](spark, small)
    want = db.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert in_order(tuple(value(r[c]) for c in columns) for r in df.collect()) == in_order(tuple(value(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
