"""Side-by-side check of a Spark query and its DuckDB oracle (local tool).

Order-insensitive: both results are converted to strings per cell, rows are
sorted, and compared together with the row count and the column names.
"""

from __future__ import annotations

import decimal
import math
import os

import duckdb
import pandas as pd

from ledgerlens.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t + '.parquet')}')")
    return con


def _cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "<null>"
    if v is pd.NaT:
        return "<null>"
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v.to_integral_value() else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        return _cell(v.tolist())
    if isinstance(v, pd.Timestamp):
        return str(v.to_pydatetime())
    return str(v)


def rows_of(columns: list[str], records) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in records)


def compare(spark, con, query, sql: str) -> dict:
    sdf = query
    s_cols = sdf.columns
    s_rows = rows_of(s_cols, [tuple(r) for r in sdf.collect()])
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rows_of(d_cols, rel.fetchall())
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": sorted(s_cols) == sorted(d_cols), "values_match": s_rows == d_rows}
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = sorted(s_cols), sorted(d_cols)
    if not out["values_match"]:
        sa, da = set(s_rows), set(d_rows)
        out["only_spark"] = sorted(sa - da)[:3]
        out["only_oracle"] = sorted(da - sa)[:3]
    return out
