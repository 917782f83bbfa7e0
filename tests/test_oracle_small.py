"""Every SQL-backed registered query against its DuckDB twin at sf0.001 (the others: test_models, tests/llm)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from agewise.sources.fixtures import TABLES

def _norm(v):
    import pandas as pd
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.item() if hasattr(v, "item") else v


def _rows(df):
    cols = sorted(df.columns)
    out = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(small_dir, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_query_matches_sql(spark, con, small_dir, key):
    got = E.queries()[key](spark, small_dir).toPandas()
    want = con.execute(E.oracle_sql()[key]).df()
    assert _rows(got) == _rows(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "adaptability_tier" in df.columns
