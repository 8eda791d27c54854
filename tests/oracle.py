"""Compare a Spark result with its SQL over the same tables in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def duck(folder: str, sql: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{at}')")
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    return sorted(columns), rows(columns, got.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, df.collect())
