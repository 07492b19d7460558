"""Every query of the catalogue against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def _plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple("" if r[i] is None else round(r[i], 6) if isinstance(r[i], float) and math.isfinite(r[i]) else str(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _plain(df.collect(), df.columns) == _plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
