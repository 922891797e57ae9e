"""Whitened vectors: covariances by polarisation from exact sums of squares, one eigenproblem per vector length."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.kdtree import usable
from verdictframe.session import checkpointed

#: Components kept, grid steps per unit, shift of the grid; rows that a task squares at once.
COMPONENTS, SCALE, SHIFT, ROWS = 8, 1024, 100_000, 4096
_FITS, _WIDEST = 2**62, 10**38


def grid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, dim, x): usable vectors as floor(1024 * c) + 100000; entries beyond 2^62 stay at 2^62."""
    edge = F.lit(_FITS)
    step = lambda c: F.greatest(-edge, F.least(edge, F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("bigint"))) + SHIFT
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.transform(vector_col, step).alias("x"))
    return rows.select("id", F.size("x").alias("dim"), "x").where("dim > 0")


def _blocks(batches, place: int):
    """(batch, row numbers, whole numbers as rows x dim) for each length in each slice of each batch."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            lists = part.column(place)
            sizes = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                yield part, rows, flat[starts[rows][:, None] + np.arange(dim)]


class _Total:
    """Exact sums of int64 vectors in two halves, whatever their number."""

    def __init__(self, size: int):
        self.high, self.low = np.zeros(size, np.int64), np.zeros(size, np.int64)

    def add(self, values: np.ndarray) -> None:
        if values.dtype == object:  # beyond int64: the high half may grow beyond it too
            self.high = self.high.astype(object)
        self.high = self.high + (values >> 32)
        self.low = self.low + (values & 0xFFFFFFFF).astype(np.int64)


def _summed(rows: DataFrame, run, *keys: str) -> list:
    """Sums of ``run``'s halves per key: one row for each dimension or pair reaches the driver, however many vectors there are."""
    shown = [f"{k} int" for k in keys]
    parts = rows.mapInArrow(run, ", ".join([*shown, "n bigint", "high decimal(38,0)", "low bigint"]))
    total = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    return total.collect()


def _wide(values: np.ndarray) -> pa.Array:
    """Whole numbers as decimal(38,0); null where one is wider."""
    if values.dtype != object:
        return pa.array(values, pa.int64()).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(int(v)) if abs(v) < _WIDEST else None for v in values], pa.decimal128(38, 0))


def _safe(values: np.ndarray, bound: int) -> np.ndarray:
    """``values`` as Python integers where results up to ``bound`` would leave int64."""
    return values if bound < _FITS else values.astype(object)


def sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per length: number of vectors and exact sum of each dimension."""

    def run(batches):
        totals: dict[int, tuple[list[int], _Total]] = {}
        for _, _, x in _blocks(batches, 1):
            count, total = totals.setdefault(x.shape[1], ([0], _Total(x.shape[1])))
            count[0] += len(x)
            total.add(_safe(x, int(np.abs(x).max()) * len(x)).sum(0))
        for dim, (count, total) in totals.items():
            columns = [np.full(dim, dim, np.int32), np.arange(dim, dtype=np.int32), np.full(dim, count[0])]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int64()), _wide(total.high), pa.array(total.low)], ["dim", "i", "n", "high", "low"])

    out: dict[int, tuple[int, list[int]]] = {}
    for r in _summed(rows.select("dim", "x"), run, "dim", "i"):
        out.setdefault(r["dim"], (r["n"], [0] * r["dim"]))[1][r["i"]] = (int(r["high"]) << 32) + int(r["low"])
    return out


@dataclass
class Fit:
    """What a task needs to whiten vectors of one length."""

    n: int
    centre: np.ndarray  # whole part of each dimension's mean
    rest: np.ndarray  # sum of what is left of each dimension, 0 <= rest < n
    axes: np.ndarray  # dim x components, unit eigenvectors
    scale: np.ndarray  # square roots of their eigenvalues; 0 where there is no variance
    explained: list[float]


def _pairs(rows: DataFrame, centres: dict[int, np.ndarray]) -> list:
    """(dim, i, j, sums): exact sum of (c_i + c_j)^2 over the centred vectors, of c_i^2 where i = j."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        totals: dict[int, _Total] = {}
        for _, _, x in _blocks(batches, 1):
            dim = x.shape[1]
            total = totals.setdefault(dim, _Total(dim * (dim + 1) // 2))
            c = x - shared.value[dim]
            c = _safe(c, 4 * int(np.abs(c).max()) ** 2 * len(c))
            out = []
            for i in range(dim):
                both = c[:, i : i + 1] + c[:, i:]
                both[:, 0] = c[:, i]
                out.append((both * both).sum(0))
            total.add(np.concatenate(out))
        for dim, total in totals.items():
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.zeros(len(i), np.int64)), _wide(total.high), pa.array(total.low)], ["dim", "i", "j", "n", "high", "low"])

    return _summed(rows.select("dim", "x"), run, "dim", "i", "j")


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Per length: exact means, and the leading eigenvectors of the covariance.

    With c = x - m for the whole part m of a mean, sum (n x - S)^2 = n (n sum c^2 - (sum c)^2) holds exactly
    for a dimension and for the sum of two. Half the difference between the value of a pair's sum and those
    of its two dimensions is their cross-covariance times n^3, a whole number that is rounded once.
    """
    totals = sums(rows)
    whole = {dim: [s // n for s in total] for dim, (n, total) in totals.items()}
    squares: dict[int, dict] = {dim: {} for dim in totals}
    for r in _pairs(rows, {dim: np.array(m, dtype=np.int64) for dim, m in whole.items()}) if totals else []:
        squares[r["dim"]][r["i"], r["j"]] = (int(r["high"]) << 32) + int(r["low"])
    out = {}
    for dim, (n, total) in totals.items():
        rest = [s - n * m for s, m in zip(total, whole[dim])]
        spread = {(i, j): n * q - ((rest[i] + rest[j]) if i != j else rest[i]) ** 2 for (i, j), q in squares[dim].items()}
        cov = np.empty((dim, dim))
        for (i, j), q in spread.items():
            cov[i, j] = cov[j, i] = (q if i == j else (q - spread[i, i] - spread[j, j]) // 2) / (n * n)
        values, axes = np.linalg.eigh(cov)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
        trace = float(np.trace(cov))
        flat = values <= dim * np.finfo(float).eps * trace
        out[dim] = Fit(n, np.array(whole[dim], np.int64), np.array(rest, dtype=object), axes, np.where(flat, 0, np.sqrt(np.maximum(values, 0))), [0.0 if f else float(v / trace) for f, v in zip(flat, values)])
    return out


def whiten(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """(id, dim, deviation, whitened): exact squared distance from the mean in units of n, and the components."""
    shared = rows.sparkSession.sparkContext.broadcast(fits)  # means and eigenvectors, one set for each length
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for part, at, x in _blocks(batches, 2):
            f = shared.value[x.shape[1]]
            c = x - f.centre
            far, rest = int(np.abs(c).max()), int(max(f.rest))
            c = _safe(c, max(far, rest) * max(far, 1) * c.shape[1])
            r = f.rest if c.dtype == object else f.rest.astype(np.int64)
            own, cross = (c * c).sum(1).astype(object), (c * r).sum(1).astype(object)
            deviation = f.n * f.n * own - 2 * f.n * cross + int((f.rest * f.rest).sum())
            centred = c.astype(np.float64) - (f.rest / f.n).astype(np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                w = np.where(f.scale > 0, centred @ f.axes / f.scale, np.nan)
            flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(np.full(len(at), x.shape[1], np.int32)), _wide(deviation), lists], ["id", "dim", "deviation", "whitened"])

    return rows.mapInArrow(run, f"id {kind}, dim int, deviation decimal(38,0), whitened array<double>")


def identity_errors(white: DataFrame, fits: dict[int, Fit]) -> dict[int, float | None]:
    """Per length: largest absolute entry of the whitened vectors' own covariance minus the identity."""
    width = max((len(f.scale) for f in fits.values()), default=0)
    at = lambda k: F.get("whitened", F.lit(k))
    if not width:
        return {}
    means = white.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), *[F.avg(at(k)).alias(f"m{k}") for k in range(width)])
    out: dict[int, float | None] = {}
    both = [(a, b) for a in range(width) for b in range(a, width)]
    second = white.join(F.broadcast(means), "dim")  # one row for each length
    cov = second.groupBy("dim").agg(*[(F.sum((at(a) - F.col(f"m{a}")) * (at(b) - F.col(f"m{b}"))) / F.first("n")).alias(f"c{a}_{b}") for a, b in both])
    for r in cov.collect():
        off = [abs(r[f"c{a}_{b}"] - (a == b)) for a, b in both if r[f"c{a}_{b}"] is not None]
        out[r["dim"]] = max(off, default=None)
    return out


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and leading component: id, component, n, deviation, whitened, explained, identity_error.

    ``n`` and ``deviation`` = sum (n x - S)^2 are exact (decimal; null beyond 38 digits). Three passes read the
    vectors: sums, sums of squares of dimensions and pairs, projection. A task keeps sums only, and only
    sums and d x d numbers reach the driver.

    Vectors that are null, empty or hold null or non-finite entries have no rows. Vectors of another
    length are a fit list of their own, with its own n and components. Fewer dimensions than ``components``
    give fewer rows. A component without variance (a single vector, copies only, too few distinct vectors)
    has whitened null and explained 0, and takes no part in identity_error, which is null if there is no
    other. Repeated rows and ids stay, null ids too; an empty table gives no rows; other columns are not read.
    """
    rows = grid(vectors, id_col, vector_col)
    fits = fit(rows, components)
    white = checkpointed(whiten(rows, fits))
    errors = identity_errors(white, fits)
    facts = [(dim, f.n, f.explained, errors.get(dim)) for dim, f in fits.items()]
    about = white.sparkSession.createDataFrame(facts, "dim int, n bigint, explained array<double>, identity_error double")
    long = white.join(F.broadcast(about), "dim").select("*", F.posexplode("whitened").alias("place", "value"))  # one row for each length
    return long.select(
        F.col("id").alias(id_col),
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        F.col("value").alias("whitened"),
        F.get("explained", F.col("place")).alias("explained"),
        "identity_error",
    )
