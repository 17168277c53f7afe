"""Comparison of a query with its SQL twin, values sorted, column order ignored."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return con


def _cell(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str(list(v))
    if pd.isna(v):
        return None
    if isinstance(v, (bool,)) or getattr(getattr(v, "dtype", None), "kind", "") == "b":
        return str(bool(v))
    return repr(round(float(v), 9)) if not isinstance(v, str) and not hasattr(v, "isoformat") else str(v)


def rows_of(df: pd.DataFrame) -> list[str]:
    return sorted(repr(tuple(_cell(v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False))


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b)
    assert a == b
