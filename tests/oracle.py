"""Compares a query with its SQL: same columns, same rows as multisets; floats to nine significant digits or 1e-9."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb
import numpy as np

SF = "/root/testdata/sf0.01"


def connection(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, np.generic):
        return plain(v.item())
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_integer_ratio"):
        return float(v)
    return v


def ordered(rows):
    coarse = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(rows, key=lambda r: tuple(map(coarse, r)))


def near(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(near, a, b))
    return a == b


def difference(df, con, sql: str) -> str:
    """Nothing if df has the rows of sql, else what differs."""
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    take = sorted(names)
    at = [names.index(c) for c in take]
    want = ordered(tuple(plain(r[i]) for i in at) for r in got.fetchall())
    have = ordered(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in take]).collect())
    if len(want) != len(have):
        return f"{len(have)} rows against {len(want)}"
    off = [(h, w) for h, w in zip(have, want, strict=True) if not near(h, w)]
    return f"{len(off)} rows differ, e.g. {off[0]}" if off else ""
