"""Compare a registered query with its oracle SQL (row count, column names,
order-insensitive value hash) — the same gate the driver applies."""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math

from pyspark.sql import SparkSession

from resgov.sources.tables import TABLES


def _canon(v) -> str:
    if v is None:
        return "NULL"
    try:
        import pandas as pd
        if v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, pd.Timestamp):
            v = v.to_pydatetime()
    except ImportError:  # pragma: no cover
        pass
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except (ValueError, AttributeError):
            pass
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6))
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return v.isoformat()
    return str(v)


def _digest(columns, rows) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_canon(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark: SparkSession, sf_dir: str, name: str, query, sql: str, con=None) -> dict:
    df = query(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    con = con or duck(sf_dir)
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    out = {"query": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": sorted(s_cols) == sorted(d_cols)}
    out["hash_match"] = out["columns_match"] and _digest(s_cols, s_rows) == _digest(d_cols, d_rows)
    if not out["columns_match"]:
        out["spark_columns"], out["oracle_columns"] = s_cols, d_cols
    out["ok"] = out["hash_match"] and len(s_rows) == len(d_rows)
    return out
