"""Every query against its SQL, on the smallest tables."""

import glob
import os
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sparkarch.plans import registry

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> list:
    value = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(value(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", [n for n in NAMES if n in registry.SQL])
def test_query_equals_sql(spark, small, duck, name):
    got, want = registry.QUERIES[name](spark, small).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in registry.SQL])
def test_query_without_sql_runs(spark, small, name):
    registry.QUERIES[name](spark, small).collect()


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_llm_part():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/sparkarch/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert not re.search(r"\bllm\b", open(path).read()), path
