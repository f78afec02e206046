"""Every query with SQL against DuckDB on the smallest tables; the others have to run."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from millrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in sorted(os.listdir(SF)) if f.endswith(".parquet")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    # an integer column with nulls arrives as floats on one side
    return str(int(v)) if isinstance(v, float) and v.is_integer() else repr(round(float(v), 6)) if isinstance(v, float) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE:
        want = duck.execute(registry.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streams(spark):
    from pyspark.sql import functions as F

    from millrace.plans.q_sources import events
    from millrace.streaming import rates

    batch = spark.read.parquet(f"{SF}/events.parquet")
    got = rates.drain(rates.sessions(events(spark, SF)), "sessions_test", "append")
    assert got.columns == ["user_id", "start", "end", "n"] and got.agg(F.sum("n")).first()[0] <= batch.count()
