"""Side-by-side check of a Spark query against its DuckDB oracle SQL.

Compares row count, column names and the multiset of rows (doubles compared
after rounding to ``digits``), independent of row order.
"""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

from ranklab.sources.tables import TABLES, table_path


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), digits)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        return _norm(v.tolist(), digits)
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    return v


def rows_of(records, cols, digits):
    return sorted((tuple(_norm(r[c], digits) for c in cols) for r in records),
                  key=lambda t: repr(t))


def compare(spark_df, con, sql: str, digits: int = 6) -> dict:
    srows = [r.asDict(recursive=True) for r in spark_df.collect()]
    scols = list(spark_df.columns)
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = [dict(zip(dcols, r)) for r in rel.fetchall()]
    out = {"spark_rows": len(srows), "oracle_rows": len(drows),
           "spark_cols": scols, "oracle_cols": dcols}
    out["cols_match"] = sorted(scols) == sorted(dcols)
    if not out["cols_match"]:
        out["ok"] = False
        return out
    cols = sorted(scols)
    a, b = rows_of(srows, cols, digits), rows_of(drows, cols, digits)
    out["values_match"] = a == b
    if not out["values_match"]:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out["first_diffs"] = [(list(zip(cols, x)), list(zip(cols, y))) for x, y in diff]
    out["ok"] = out["values_match"] and len(srows) == len(drows)
    return out
