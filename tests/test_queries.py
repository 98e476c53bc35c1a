"""Every query with SQL gives the rows that DuckDB gives for it."""

import math
import os

import duckdb
import pytest

from tidemark.plans import catalog, oracle

SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda x: "null" if x is None or x is duckdb or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT") else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(cell(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, data, name):
    got, want = catalog.queries()[name](spark, data).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {f.__name__ for f in catalog.ALL} <= set(e.queries())
