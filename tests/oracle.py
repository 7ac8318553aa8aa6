"""Runs a registered query and its SQL on the same tables and compares the rows."""

import glob
import math
import os

import duckdb


def rows(spark, base, query, sql=None):
    mine = query(spark, base).toPandas()
    if sql is None:
        return mine, None
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{base}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{src}'")
    return mine, con.execute(sql).df()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    try:
        if v != v:
            return None
    except (TypeError, ValueError):
        return None
    if hasattr(v, "isoformat"):
        return str(v)[:26].replace("+00:00", "")
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    return v


def same(a, b):
    """'' if the frames hold the same rows, else what differs."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    cols = sorted(a.columns)
    x, y = (sorted((tuple(norm(v) for v in r) for r in f[cols].itertuples(index=False, name=None)), key=repr) for f in (a, b))
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows; only here {list(set(x) - set(y))[:2]}; only there {list(set(y) - set(x))[:2]}"
    for p, q in zip(x, y):
        if p != q and not all(u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=2e-6)) for u, v in zip(p, q)):
            return f"{p} and {q}"
    return ""
