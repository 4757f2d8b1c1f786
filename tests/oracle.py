"""Run SQL in DuckDB over the test tables and compare it with a Spark result."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import numpy as np

from evigraph.sources.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = Path(folder, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(x is None, str(type(x)), x) for x in r])


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    got = rows_of(df.columns, df.collect())
    assert got == rows_of(want.columns, want.fetchall())
    return len(got)
