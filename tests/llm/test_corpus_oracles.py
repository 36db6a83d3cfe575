"""The corpus queries that SQL can express against DuckDB, all rows and values."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from plumeria.llm import queries


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, numbers.Number) else x
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)
