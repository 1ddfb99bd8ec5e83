"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from docloom import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_equal_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    ours = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    theirs = sorted(repr([plain(v) for v in r]) for r in duck.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]}) q").fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["table_id", "record", "key", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
