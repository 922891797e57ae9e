"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(rows: int, per_part: int) -> int:
    """Number of groups so that a group holds about ``per_part`` rows, whatever the row count."""
    return max(1, -(-rows // per_part))


def strings(column: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    """Values of a string column; null reads as the empty text."""
    for x in column:
        yield x.as_py() or ""


def roots(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under the links (a[i], b[i])."""
    p = np.arange(n) if start is None else start
    while len(a):
        pa_, pb_ = p[a], p[b]
        open_ = pa_ != pb_
        if not open_.any():
            break
        a, b, pa_, pb_ = a[open_], b[open_], pa_[open_], pb_[open_]
        np.minimum.at(p, np.maximum(pa_, pb_), np.minimum(pa_, pb_))
        while True:
            q = p[p]
            if np.array_equal(q, p):
                break
            p = q
    return p


def row_key(*columns: Column) -> list[Column]:
    """Two 64-bit hashes of the columns, nulls included: a key for rows that have no id of their own."""
    shown = [F.coalesce(c.cast("string"), F.lit("\x00null")) for c in columns]
    return [F.xxhash64(*shown), F.xxhash64(F.lit(7), *shown)]


def list_column(values: Iterable[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one array per row, without a Python object per value."""
    values = list(values)
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))
