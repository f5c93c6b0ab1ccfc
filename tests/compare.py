"""Spark's rows against DuckDB's."""

import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def shown(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(shown(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def spark_rows(df) -> list[tuple]:
    return rows(pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns))
