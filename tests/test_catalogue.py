"""Every registered graph query against DuckDB on the smallest tables."""

import math
import numbers
import os

import duckdb
import pandas as pd
import pytest

from graphloom import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{float(v):.5f}" if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        wanted = con.sql(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(wanted.columns)
        assert normal(got) == normal(wanted)
