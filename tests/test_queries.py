"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from docmill.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(df):
    names = sorted(df.columns)
    shown = lambda v: "-" if pd.isna(v) else repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return names, sorted(tuple(map(shown, r)) for r in df[names].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, name):
    assert rows(__spark_entry__.queries()[name](spark, FOLDER).toPandas()) == rows(duck.execute(__spark_entry__.oracle_sql()[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
