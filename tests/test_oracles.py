"""Every registered query with a DuckDB equivalent gives the same rows; the others run and are not empty."""

import datetime
import decimal

import duckdb
import pytest

from siltstone import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


#: Tables that one plan may read: what more would need is written first.
MOST_LEAVES = 60


def leaves(df):
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    ref = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in ref.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, ref.fetchall())
    assert leaves(df) <= MOST_LEAVES


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    once = registry.QUERIES[name](spark, DIR)
    rows = sorted(map(repr, once.collect()))
    assert once.columns and rows and leaves(once) <= MOST_LEAVES
    assert rows == sorted(map(repr, registry.QUERIES[name](spark, DIR).repartition(3).collect()))
