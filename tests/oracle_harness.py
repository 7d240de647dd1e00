"""Run a registered query in Spark and its oracle SQL in DuckDB and compare.

Mirrors the driver's check: row count, column names, and an order-insensitive
hash of the values (columns sorted by name).
"""

from __future__ import annotations

import hashlib
import math
import os

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        # a null makes pandas read longs as floats, DuckDB as nullable integers
        return int(v) if v.is_integer() else float(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def fingerprint(pdf: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows.append(repr(tuple(_norm(v) for v in rec)))
    rows.sort()
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(pdf), cols, h


def compare(spark_df, sql: str, con) -> dict:
    a = spark_df.toPandas()
    b = con.execute(sql).df()
    fa, fb = fingerprint(a), fingerprint(b)
    res = {"rows": (fa[0], fb[0]), "cols_match": fa[1] == fb[1], "hash_match": fa[2] == fb[2]}
    if not res["cols_match"]:
        res["cols"] = (fa[1], fb[1])
    elif not res["hash_match"] and fa[0] == fb[0]:
        cols = fa[1]
        sa = a[cols].sort_values(cols, na_position="first").reset_index(drop=True)
        sb = b[cols].sort_values(cols, na_position="first").reset_index(drop=True)
        diffs = []
        for c in cols:
            xa = [_norm(v) for v in sa[c]]
            xb = [_norm(v) for v in sb[c]]
            bad = [i for i, (p, q) in enumerate(zip(xa, xb)) if p != q]
            if bad:
                diffs.append((c, len(bad), xa[bad[0]], xb[bad[0]]))
        res["diffs"] = diffs[:6]
    return res
