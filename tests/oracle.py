"""Comparison of a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{files}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        return f"{v:.9g}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=str)


def as_floats_or_ints(a: pd.DataFrame, b: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Integer columns that pandas made floats because of nulls, made alike on both sides."""
    for c in a.columns:
        if {a[c].dtype.kind, b[c].dtype.kind} == {"f", "i"}:
            a[c], b[c] = a[c].astype(float), b[c].astype(float)
    return a, b


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    got, want = as_floats_or_ints(got.copy(), want.copy())
    assert rows(got) == rows(want)
