"""Every registered query runs on the smallest tables; those with SQL give DuckDB's rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpusloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if isinstance(v, list | np.ndarray):
            return tuple(v)
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].astype(object)
    ints = {c for c in df if df[c].map(lambda v: isinstance(v, int | np.integer) or v is None or isinstance(v, float) and (np.isnan(v) or v.is_integer())).all()}
    return sorted(tuple("" if c in ints and pd.isna(v) else str(int(v)) if c in ints else plain(v) for c, v in zip(df.columns, r, strict=True)) for r in df.to_numpy().tolist())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, sf, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
