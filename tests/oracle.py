"""Hold a query's rows against its SQL, run by DuckDB over the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    """Values as they are compared: numbers to 6 significant places, dates and nested values as text."""
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") and hasattr(v, "year") else v.isoformat()
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in sorted(v.items())})
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if hasattr(v, "as_tuple"):
        return f"{float(v):.6g}"
    return str(v)


def compare(spark, query, sql: str, sf_dir: str, show: int = 5) -> str:
    """Empty if the rows are equal as a bag; else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = connect(sf_dir).sql(sql)
    if sorted(found.columns) != names:
        return f"columns {names} and {sorted(found.columns)}"
    at = [found.columns.index(c) for c in names]
    want = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    if got == want:
        return ""
    a, b = set(got), set(want)
    return f"{len(got)} rows and {len(want)}; only here {sorted(a - b)[:show]}; only there {sorted(b - a)[:show]}"
