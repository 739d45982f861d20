"""Local twin of the driver's correctness gate: run a registered Spark query
and its SQL twin (DuckDB over the same parquet files) and compare row count,
column names and an order-insensitive hash of the values."""

from __future__ import annotations

import hashlib

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v != v:
        return "NULL"
    if isinstance(v, bool):
        return "1" if v else "0"
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v) if isinstance(v, float) else str(v)


def frame_hash(pdf: pd.DataFrame) -> str:
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in pdf.to_dict("records"))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def compare(spark, query, sf_dir: str, con=None):
    con = con or duck(sf_dir)
    s = query.build(spark, sf_dir).toPandas()
    d = con.execute(query.sql).fetchdf()
    res = {"rows": (len(s), len(d)), "cols_equal": sorted(s.columns) == sorted(d.columns)}
    res["hash_equal"] = res["cols_equal"] and frame_hash(s) == frame_hash(d[s.columns])
    if res["cols_equal"] and not res["hash_equal"] and len(s) == len(d):
        cols = sorted(s.columns)
        key = cols
        ss = s[cols].astype(str).sort_values(key).reset_index(drop=True)
        dd = d[cols].astype(str).sort_values(key).reset_index(drop=True)
        bad = [c for c in cols if not (ss[c] == dd[c]).all()]
        res["bad_cols"] = bad
    return res, s, d
