"""Every registered query of the library against DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from umbral import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else str(x))
        elif df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype.kind in "fi":
            df[c] = df[c].astype(float).round(5)
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got.columns)
        return
    a, b = tidy(got), tidy(duck.sql(SQL[name]).df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if x.dtype.kind == "f" and y.dtype.kind == "f":
            same |= np.isclose(x, y, rtol=1e-9, atol=1e-5, equal_nan=True)
        assert same.all(), (c, x[~same].head(3).tolist(), y[~same].head(3).tolist())
