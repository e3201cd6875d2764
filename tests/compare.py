"""Rows of a Spark query beside those of SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    found = con.sql(sql)
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == dict(zip(found.columns, map(str, found.types), strict=True))
    pd.testing.assert_frame_equal(ordered(df.toPandas()), ordered(found.df()), check_dtype=False, check_exact=False, rtol=0, atol=2e-6)
