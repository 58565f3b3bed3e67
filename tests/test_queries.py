"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lexitide.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    def text(x):
        if x is None or not isinstance(x, (list, dict, tuple)) and not hasattr(x, "shape") and pd.isna(x):
            return None
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    got, want = normal(catalog.QUERIES[name](spark, SF).toPandas()), normal(con.sql(catalog.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
