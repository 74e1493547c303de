"""Differential check: registered queries vs their DuckDB oracle (sf0.001)."""
import math

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
SKIP = {"f01_list_periods"}  # covered in the full sf0.01 comparison (writes a published table)


def _norm(v):
    import pandas as pd
    if v is None or v is pd.NA:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - SKIP))
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dd = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    cols = sorted(sp.columns)
    rows = lambda df: sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)), key=repr)
    assert rows(sp) == rows(dd)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "tot_in_batch" in df.columns
