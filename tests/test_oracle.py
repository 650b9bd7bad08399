"""Every registered query against DuckDB on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from kinewave.plans import registry

TABLES = ("events", "embeddings", "labels", "documents")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.environ.get('ORACLE_SF', SF)}/{t}.parquet')")
    return con


def frame(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows[sorted(rows.columns)]
    for c in rows.columns:
        if rows[c].dtype.kind in "iuf":
            rows[c] = rows[c].astype(float)
    return rows.sort_values(list(rows.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(name, spark, duck):
    got = frame(registry.queries()[name](spark, os.environ.get("ORACLE_SF", SF)).toPandas())
    want = frame(duck.execute(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) and len(got)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


def test_queries_without_sql(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, SF).count() > 0
