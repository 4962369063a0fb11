"""Every query with SQL against DuckDB on the smallest tables, and the rest for their rows."""

import math
import os

import duckdb
import pytest

from groundtrack.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{v:.6g}") if isinstance(v, float) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_repeat(spark, sf_dir, name):
    """Queries without SQL: rows, and the same ones from another partitioning."""
    a = rows(QUERIES[name](spark, sf_dir).columns, QUERIES[name](spark, sf_dir).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    b = rows(QUERIES[name](spark, sf_dir).columns, QUERIES[name](spark, sf_dir).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a and a == b
