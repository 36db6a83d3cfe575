"""Every registered query against its DuckDB counterpart, all rows and values."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from plumeria.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, numbers.Number) else x
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_duckdb(spark, duck, sf_dir, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
