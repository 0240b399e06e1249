"""Registered queries against their SQL on the smallest tables."""

import os

import pandas as pd
import pytest

from factweave.plans import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def cell(x):
    if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)):
        return "NULL"
    return repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
