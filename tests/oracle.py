"""Compares a query with its SQL, row by row, without regard to order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def value(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return None
    if isinstance(x, (bool, str, bytes)):
        return str(x)
    if hasattr(x, "item"):
        x = x.item()
    return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(value, r)) for r in frame.itertuples(index=False)), key=str)
