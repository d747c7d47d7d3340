"""Whitening of embeddings: float32 eigenvectors of a distributed covariance, refined in higher precision.

Vectors become whole numbers (256 times an entry, rounded down), the fit is on the distinct ones. Spark adds up, task by task, first
the sums S, then the products of entries centred at round(S / n); all are whole numbers, added without rounding, so the covariance
is rounded once, when it becomes a float. What reaches the driver is one row a dimension, whatever the number of vectors.

The driver takes eigenvectors in float32 and corrects them by the iteration of Ogita and Aishima (2018), which needs matrix products
only and doubles the right digits each time; products are in extended precision. Eigenvalues nearer than the iteration can tell apart
are a cluster: it only makes their vectors orthonormal, after which the matrix, projected on them and shifted by their mean, is solved
as a small problem of its own and its solution turns them (Ogita and Aishima, 2019).

Defined results: rows whose vector is null or has a null, infinite or NaN entry are left out; shorter vectors are filled with zeros up
to the longest; entries beyond 64 bits become the nearest 64-bit number; repeated rows stay repeated and count once in the fit; null ids
are kept; equal eigenvalues share any basis of their plane, the same for all rows; a component without variance gives 0 for whitened and
explained; an empty table gives no rows; a deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import small_batches, stash, table

SCALE, KEEP = 256, 4
#: Whole numbers below this have products that float64 adds up exactly, 4,096 at a time.
EXACT, ROWS = 1 << 20, 4096
WIDE = np.longdouble


def quantized(vector: Column) -> Column:
    """Entries times SCALE, rounded down, as longs; null where the vector is null or an entry is null or not finite."""
    entry = lambda c: c.cast("double")
    good = F.forall(vector, lambda c: F.coalesce(~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf")), F.lit(False)))
    top, low = float(1 << 63), -float(1 << 63)
    whole = lambda v: F.when(v >= top, F.lit((1 << 63) - 1)).when(v <= low, F.lit(-(1 << 63))).otherwise(F.floor(F.when(F.abs(v) < top, v)))
    return F.when(good, F.transform(vector, lambda c: whole(entry(c) * SCALE)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as an int64 matrix of the given width, shorter rows filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def gram(y: np.ndarray) -> np.ndarray:
    """Products of the columns of a matrix of whole numbers, exact, as Python ints."""
    if y.dtype == object:
        return y.T.dot(y)
    small = (np.abs(y) < EXACT).all(axis=1)
    part = y[small].astype(np.float64)
    out = (part.T @ part).astype(np.int64).astype(object)  # below 2**52: every step is exact
    rest = y[~small].astype(object)
    return out + rest.T.dot(rest) if len(rest) else out


def added(vectors: DataFrame, width: int, rows_of) -> list[list[int]]:
    """Sums, over all vectors, of the rows of whole numbers that rows_of makes of a matrix: one list for each row number. Each task sends one row a row number; they are added by row number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = matrix(b.column(0), width)
            for lo in range(0, len(x), ROWS):
                now = rows_of(x[lo : lo + ROWS])
                total = now if total is None else total + now
        if total is not None:
            texts = [[str(v) for v in row] for row in total]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.list_(pa.string()))], names=["i", "v"])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        sums = [0] * len(t.column("v")[0])
        for row in t.column("v"):
            sums = [s + int(v) for s, v in zip(sums, row.as_py(), strict=True)]
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([[str(s) for s in sums]], pa.list_(pa.string()))})

    found = vectors.select("x").mapInArrow(run, "i int, v array<string>").groupBy("i").applyInArrow(add, "i int, v array<string>").collect()
    return [[int(v) for v in r.v] for r in sorted(found, key=lambda r: r.i)]


def refine(a: np.ndarray, x: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and vectors of the symmetric a from approximate vectors x, by matrix products in extended precision and small problems for clusters."""
    a, x = a.astype(WIDE), x.astype(WIDE)
    eye, norm = np.eye(len(a), dtype=WIDE), np.linalg.norm(a.astype(np.float64))
    solved = False
    for _ in range(steps):
        r = eye - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        near = 2 * (np.linalg.norm(off.astype(np.float64)) + norm * np.linalg.norm(r.astype(np.float64)))
        gaps = values[None, :] - values[:, None]
        apart = np.abs(gaps) > near
        # What no step can tell apart: by less than the last digits of a itself.
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
        x = x + x @ e
        change = np.abs(e).max()
        if change < 1e-9 and not solved:
            x, solved = separate(a, x, near), True
        elif change < 1e-17:
            break
    r = eye - x.T @ x
    x = x + x @ r / 2
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), x[:, order].astype(np.float64)


def separate(a: np.ndarray, x: np.ndarray, near: float) -> np.ndarray:
    """Turns the vectors of each cluster of eigenvalues, a chain of gaps below near, by the solution of the small problem that a is on them, shifted by their mean and scaled."""
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > max(near, 1e-9 * np.abs(values).max())) + 1
    for group in np.split(order, cuts):
        if len(group) > 1:
            own = x[:, group]
            small = own.T @ (a @ own - own * values[group].mean())
            scale = np.abs(small).max()
            if scale > 0:
                _, turn = np.linalg.eigh((small / scale).astype(np.float64))
                x[:, group] = own @ turn.astype(WIDE)
    return x


@dataclass
class Whitening:
    """n distinct vectors with sums S; centre is round(S / n), rest is S - n * centre. Columns of vectors are components by falling eigenvalue."""

    n: int
    sums: list[int]
    centre: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """(x - S / n) on the first k components over sqrt(eigenvalue): whole numbers are subtracted first, the fraction of the mean after."""
        y = (x - np.array(self.centre, dtype=x.dtype)).astype(np.float64) - np.array([float(Fraction(s - self.n * c, self.n)) for s, c in zip(self.sums, self.centre, strict=True)])
        return y @ self.directions(k)

    def directions(self, k: int) -> np.ndarray:
        e = self.values[:k]
        live = e > 1e-13 * max(self.trace, 0.0)
        return np.where(live, self.vectors[:, :k] / np.sqrt(np.where(live, e, 1)), 0.0)

    def explained(self, k: int) -> list[float]:
        return [max(float(e), 0.0) / self.trace if self.trace > 0 else 0.0 for e in self.values[:k]]

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) ** 2, exact; None beyond 64 bits."""
        most = self.n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, self.sums), default=0)
        if most * most * max(self.width, 1) < 1 << 63:
            d = x * self.n - np.array(self.sums, dtype=np.int64)
            return (d * d).sum(1).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return [v if v < 1 << 63 else None for v in (d * d).sum(1)]


def wide_enough(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """Python ints where 64 bits could overflow in a difference."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), *map(abs, centre))
    return x if most < 1 << 61 else x.astype(object)


def fit(vectors: DataFrame) -> Whitening | None:
    """vectors: x, distinct lists of longs. None if there are none or all are empty."""
    width = vectors.agg(F.max(F.size("x"))).first()[0]
    if not width or width < 1:
        return None
    small_batches(vectors.sparkSession)
    total = added(vectors, width, lambda x: np.concatenate([[len(x)], x.sum(0) if np.abs(x).max(initial=0) < EXACT else x.astype(object).sum(0)]).astype(object)[None, :])
    n, sums = total[0][0], total[0][1:]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    products = added(vectors, width, lambda x: gram((w := wide_enough(x, centre)) - np.array(centre, dtype=w.dtype)))
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    # (n * products - rest rest') / n**2, each entry rounded once: division of Python ints is correctly rounded.
    cov = np.array([[(n * products[i][j] - rest[i] * rest[j]) / (n * n) for j in range(width)] for i in range(width)])
    trace = float(Fraction(sum(n * products[i][i] - rest[i] ** 2 for i in range(width)), n * n))
    size = np.abs(cov).max()
    if not size > 0:
        return Whitening(n, sums, centre, np.zeros(width), np.eye(width), 0.0)
    _, start = np.linalg.eigh((cov / size).astype(np.float32))
    values, found = refine(cov / size, start)
    found = found * np.where(found[np.abs(found).argmax(0), np.arange(width)] < 0, -1.0, 1.0)
    return Whitening(n, sums, centre, values * size, found, trace)


def identity_error(vectors: DataFrame, model: Whitening, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity: sums of each task, k * (k + 1) numbers, added."""
    width, centre = model.width, model.centre

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            w = model.project(wide_enough(matrix(b.column(0), width), centre), k)
            total += np.vstack([w.T @ w, w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k + 1), k)), pa.array(np.tile(np.arange(k), k + 1)), pa.array(total.ravel())], names=["i", "j", "v"])

    cells = vectors.select("x").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((k + 1, k))
    for r in cells:
        total[r.i, r.j] = r.v
    mean = total[k] / model.n
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening, k: int, error: float) -> DataFrame:
    """A row for each vector and component. rows: vec_id and x."""
    width, centre, n, shares = model.width, model.centre, model.n, model.explained(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = wide_enough(matrix(b.column(1), width), centre)
            m = len(x)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation, pa.array(model.project(x, k).ravel()), pa.array(np.tile(np.array(shares), m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    small_batches(rows.sparkSession)
    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten_table(table_: DataFrame, id_name: str = "vec_id", vector_name: str = "embedding", keep: int = KEEP) -> DataFrame:
    """Fits on the distinct quantized vectors of a table and whitens all its rows on the first components."""
    rows = table_.select(F.col(f"`{id_name}`").cast("long").alias("vec_id"), quantized(F.col(f"`{vector_name}`")).alias("x")).filter("x is not null")
    vectors = stash(rows.select("x").distinct(), "vectors")
    model = fit(vectors)
    if model is None:
        return rows.limit(0).selectExpr("vec_id", "0 component", "0L n", "0L deviation", "0D whitened", "0D explained", "0D identity_error")
    k = min(keep, model.width)
    return whiten(rows, model, k, identity_error(vectors, model, k))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_table(table(spark, sf_dir, "embeddings"))
