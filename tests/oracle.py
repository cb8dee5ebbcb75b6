"""Local copy of the correctness gate: run a registered Spark query and its
DuckDB oracle on the same parquet tables and compare row count, column names
and order-insensitive values."""

from __future__ import annotations

import math
import os

import duckdb

from tabwright.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t + '.parquet')}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 5)
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict, str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(records, cols):
    out = [tuple(_norm(r[c]) for c in cols) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in t))


def compare(spark, con, name, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    scols = sorted(sdf.columns)
    res = {"name": name, "spark_rows": len(srows)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    ddf = con.execute(sql).fetchdf()
    dcols = sorted(ddf.columns)
    res["oracle_rows"] = len(ddf)
    if scols != dcols:
        res["status"] = f"columns differ {scols} vs {dcols}"
        return res
    drecs = ddf.to_dict("records")
    a, b = rows_of(srows, scols), rows_of(drecs, scols)
    if len(a) != len(b):
        res["status"] = "row count differs"
        return res
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    res["status"] = "ok" if not bad else f"{len(bad)} rows differ, e.g. {bad[:2]}"
    return res
