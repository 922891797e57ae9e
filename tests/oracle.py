"""Compare a registered query with its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb

TIMES: dict[str, tuple[float, float]] = {}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan" if math.isnan(v) else repr(round(v, 6) + 0.0))
    if isinstance(v, int):
        return (2, repr(float(v)) if abs(v) < 2**53 else str(v))
    return (3, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(name, df, sql, con):
    """None when equal, else a short description of the difference."""
    start = time.time()
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    middle = time.time()
    cur = con.execute(sql)
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    TIMES[name] = (middle - start, time.time() - middle)
    if sorted(got_cols) != sorted(want_cols):
        return f"{name}: columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return f"{name}: {len(a)} vs {len(b)} rows; spark only {only_a}; sql only {only_b}"
    return None
