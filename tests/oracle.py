"""Compares a Spark result with DuckDB's over the same Parquet tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connect(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def cell(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "~"
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return str(round(float(value), 6))
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    ordered = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in ordered.itertuples(index=False))
