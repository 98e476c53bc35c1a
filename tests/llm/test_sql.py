"""The subpackage's SQL gives the rows of its queries."""

import os

import duckdb
import pandas as pd
import pytest

from tests.test_queries import rows
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, data, name):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    df, sql = queries.queries()[name](spark, data), c.execute(queries.SQL[name])
    names = [x[0] for x in sql.description]
    # as objects, so that whole numbers beside nulls stay whole
    got, want = (pd.DataFrame([tuple(r) for r in x], columns=n, dtype=object) for x, n in ((df.collect(), df.columns), (sql.fetchall(), names)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
