"""Every registered query runs; those with a SQL twin give the twin's rows."""

import math
import os

import duckdb
import pytest

from sumfold.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return repr(0.0 if x == 0 else x) if math.isfinite(x) else str(x)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else repr(x)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(got, df.columns) == rows_of(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
