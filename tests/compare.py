"""Compare a Spark result with DuckDB's, without regard to row order."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype") and getattr(v, "ndim", 1) == 0 or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=str)


def tables(folder=DATA):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def same(df, sql, folder=DATA):
    assert rows(df.toPandas()) == rows(tables(folder).execute(sql).df())
