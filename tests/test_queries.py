"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import datetime
import math

import duckdb
import pytest

from atheneum.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return str(value) if isinstance(value, (datetime.date, datetime.datetime)) else value


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([plain(r[i]) for i in at]) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    want = duck.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["list_pages_by_chapter"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan and "PushedFilters" in plan


def test_entry(spark, duck):
    import __spark_entry__

    found, want = __spark_entry__.entry(spark), duck.sql(registry.ORACLE["hybrid_search"])
    assert rows(found.columns, found.collect()) == rows(want.columns, want.fetchall()) and found.count() == 10
