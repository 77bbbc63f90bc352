"""Rows of Spark and DuckDB in one form."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat().replace("+00:00", "").replace("T00:00:00", "")
    if isinstance(value, (int, float)) or type(value).__module__ == "numpy" or type(value).__name__ == "Decimal":
        return None if value != value else f"{float(value):.9g}"
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(plain(v) for v in r)) for r in frame.itertuples(index=False, name=None))
