"""Rows of a Spark result and of a DuckDB query in a form that can be compared."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, np.generic):
        return plain(v.item())
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v.is_integer() else round(v, 6)
    return str(v) if isinstance(v, pd.Timestamp) else v


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def duck(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).fetch_df()


def assert_equal(df, sql: str, sf_dir: str) -> None:
    got, expected = df.toPandas(), duck(sql, sf_dir)
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
