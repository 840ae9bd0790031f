"""Whitening of embeddings by principal components from FEAST contour integration.

Spark makes the covariance: distinct integer vectors, their exact sums, and exact
second moments about the nearest integers to the means. Its size is the square of
the dimension, whatever the rows. The components are found in slices of the
spectrum, a task each: inertia counts (Sylvester's law) place the slices' ends and
say how many eigenvalues lie between them; complex shifted solves at the points of
a quadrature around a slice project onto its eigenvectors; Rayleigh-Ritz takes
them out; and a slice is done when as many are found as were counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.common import field, store

#: Quadrature points on the upper half of a contour, eigenvalues of a slice at most (a cluster may have more), iterations,
#: and iterations after which points and vectors are doubled.
POINTS = 8
SLICE = 8
ITERATIONS = 60
PATIENCE = 12
#: Dimensions at most: the covariance is sent to each task.
MOST_DIMENSIONS = 4096
#: Entries beyond this size count as this size, so that integers stay exact.
MOST_ENTRY = float(2**44)
_SAFE = 2.0**52


class NotConverged(ArithmeticError):
    """A slice whose eigenvalues were not all found."""


class Inertia:
    """Counts of the eigenvalues of a symmetric matrix above a shift, by Sylvester's law: the signs of the factors of the
    shifted matrix, which Householder steps have made tridiagonal once, so that a count costs its dimension."""

    def __init__(self, v: np.ndarray):
        a, n = v.copy(), len(v)
        for k in range(n - 2):
            x = a[k + 1 :, k].copy()
            if length := float(np.sqrt(x @ x)):
                x[0] += np.copysign(length, x[0])
                x /= np.sqrt(x @ x)
                p = a[k + 1 :, k + 1 :] @ x
                w = p - (x @ p) * x
                a[k + 1, k] = -2 * x[0] * (x @ a[k + 1 :, k]) + a[k + 1, k]
                a[k + 1 :, k + 1 :] -= 2 * (np.outer(x, w) + np.outer(w, x))
        self.reach = float(np.abs(v).sum(1).max(initial=0))  # no eigenvalue is greater
        self.tiny = max(self.reach * np.finfo(float).eps, np.finfo(float).tiny)
        self.diagonal, self.squares = a.diagonal().tolist(), [0.0, *(a.diagonal(-1) ** 2).tolist()]

    def above(self, shift: float) -> int:
        """How many eigenvalues are greater than `shift`."""
        count, factor = 0, 1.0
        for d, s in zip(self.diagonal, self.squares, strict=True):
            factor = d - shift - s / factor
            if abs(factor) < self.tiny * 1e-3:
                factor = -self.tiny * 1e-3
            count += factor > 0
        return count

    def place(self, number: int) -> float:
        """About where the eigenvalue of that number stands, the greatest being 1."""
        low, high = -self.reach, self.reach
        for _ in range(56):
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) >= number else (low, middle)
        return (low + high) / 2


def slices_of(v: np.ndarray, most: int) -> list[tuple[float, float, int]]:
    """(low, high, count): disjoint intervals that hold the `most` greatest eigenvalues of `v` (more, if some tie), greatest
    first. Those within the rounding of `v` are left out. Between the intervals, and above the first, there are none."""
    inertia = Inertia(v)
    least = 4 * len(v) * inertia.tiny
    positive = inertia.above(least)
    places = {positive + 1: least}
    place = lambda k: places[k] if k in places else places.setdefault(k, inertia.place(k))
    gap = lambda k: place(k) - place(k + 1)
    found, done = [], 0
    while done < min(most, positive):
        inner = lambda k: place(done + 1) - place(k)  # noqa: B023, E731
        margin = lambda k: min(gap(k), gap(done) if done else np.inf) / 2  # noqa: B023, E731
        clear = [k for k in range(done + 1, min(done + SLICE, positive) + 1) if gap(k) > 16 * least]
        # as many as have gaps about them that are a fair part of the interval, or else those with the fairest
        at = max(clear, key=lambda k: (min(margin(k) / (inner(k) + margin(k)), 0.02), k), default=min(done + SLICE, positive))
        while at < positive and gap(at) <= 16 * least:  # ties go together
            at += 1
        low, high = place(at) - margin(at), place(done + 1) + margin(at)
        if inertia.above(high) != done or inertia.above(low) != at:
            raise NotConverged(f"no clear gap around the eigenvalues {done + 1} to {at}")
        found.append((float(low), float(high), at - done))
        done = at
    return found


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenvalues of `v` between `low` and `high`, and their eigenvectors as columns.

    Each iteration applies the spectral projector of the interval, as a Gauss-Legendre quadrature of resolvents over a
    circle, to a block of vectors somewhat wider than the count, and takes Ritz pairs of the result. Where eigenvalues
    crowd outside, the block may hold a mixture of those above and below, whose Ritz value lies inside and belongs to
    no eigenvalue: the pairs with the least residuals are taken, and every PATIENCE iterations the quadrature gets twice
    the points and the block twice the vectors, up to all."""
    n = len(v)
    points, width = POINTS, min(n, count + max(4, count // 2))
    centre, radius = (low + high) / 2, (high - low) / 2
    rng = np.random.default_rng(seed)
    block = rng.standard_normal((n, width))
    norm, before = max(float(np.abs(v).sum(1).max()), np.finfo(float).tiny), np.inf
    for k in range(ITERATIONS):
        if k and k % PATIENCE == 0:
            points, width = 2 * points, min(n, 2 * width)
            block = np.c_[block, rng.standard_normal((n, width - block.shape[1]))]
        projected = np.zeros(block.shape)
        for x, w in zip(*np.polynomial.legendre.leggauss(points), strict=True):
            turn = radius * np.exp(-0.5j * np.pi * (x - 1))
            projected += (0.5 * w * turn * np.linalg.solve((centre + turn) * np.eye(n) - v, block)).real
        basis, sizes, _ = np.linalg.svd(projected, full_matrices=False)
        basis = basis[:, sizes > 1e-13 * sizes.max(initial=0)]
        values, ritz = np.linalg.eigh(basis.T @ v @ basis)
        block = basis @ ritz
        residuals = np.abs(v @ block - block * values).max(axis=0, initial=0) / norm
        inside = np.flatnonzero((values > low) & (values < high))
        best = np.sort(inside[np.argsort(residuals[inside], kind="stable")[:count]])
        error = residuals[best].max(initial=0) if len(best) == count else np.inf
        if error < 1e-13 * n and error >= 0.5 * before:  # rounding is all that is left
            return values[best], block[:, best]
        before = error
    raise NotConverged(f"{len(inside)} of {count} eigenvalues between {low} and {high}, residuals {residuals[inside]}")


def principal_components(spark: SparkSession, v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` greatest eigenvalues of a covariance that exceed its rounding, falling, and unit eigenvectors as
    rows. Slices of the spectrum are tasks; what they return is bounded by `most` vectors, or by a cluster of ties."""
    cut = slices_of(v, most)
    if not cut:
        return np.zeros(0), np.zeros((0, len(v)))
    sent = spark.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                values, vectors = feast(sent.value, s["low"], s["high"], s["count"])
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(list(vectors.T), pa.list_(pa.float64()))], names=["value", "vector"])

    tasks = spark.createDataFrame(cut, "low double, high double, count long").repartition(len(cut))
    got = tasks.mapInArrow(run, "value double, vector array<double>").toArrow()
    order = np.argsort(-got.column("value").to_numpy(), kind="stable")
    basis = np.array(got.column("vector").to_pylist())[order].T
    # slices were solved apart: one more Rayleigh-Ritz step makes their vectors orthogonal to rounding
    basis, _ = np.linalg.qr(basis)
    values, ritz = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], (basis @ ritz[:, order]).T


def integer_vector(vector: Column, scale: int, offset: int) -> Column:
    """floor(scale * x) + offset of each component as long; null for vectors that are null or hold a null, NaN or infinity."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    held = lambda x: F.greatest(F.lit(-MOST_ENTRY), F.least(F.lit(MOST_ENTRY), F.lit(scale) * x.cast("double")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(held(x)).cast("long") + offset))


def _array(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _exactly(x: np.ndarray, rows: int, factor: float = 1.0) -> np.ndarray:
    """`x` as doubles if sums of `rows` products of it stay exact there, or else as Python integers."""
    return x.astype(float) if (factor * float(np.abs(x).max(initial=0))) ** 2 * max(rows, 1) < _SAFE else x.astype(object)


def _summed(df: DataFrame, parts) -> dict[int, int]:
    """Exact sums over all rows by cell: `parts` gives an array of integers a batch, and there are as many sums as it has cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = parts(batch.column(0)).astype(object)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([int(t) for t in total], pa.decimal128(38, 0))], names=["cell", "sum"])

    cells = df.mapInArrow(run, "cell int, sum decimal(38,0)").groupBy("cell").agg(F.sum("sum").alias("sum"))
    return {r["cell"]: int(r["sum"]) for r in cells.collect()}


@dataclass
class Whitening:
    """n: vectors fitted. sums: of each dimension. values, components: eigenvalues, falling, and unit rows. explained: shares
    of the trace. error: the largest entry of the whitened covariance minus the identity (0 without components)."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    @property
    def shift(self) -> np.ndarray:
        """The integers next to the means, from below."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """The means less `shift`."""
        return np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers less the means, on the components, each over its standard deviation."""
        return ((x - self.shift).astype(float) - self.rest) @ self.components.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The exact squared distance of n * x from the sums, held to the range of long."""
        y, rest = x - self.shift, np.array([s % self.n for s in self.sums])
        reach = self.n * (float(np.abs(y).max(initial=0)) + 1)
        if reach**2 * x.shape[1] < 2.0**62:
            return ((self.n * y - rest) ** 2).sum(1).tolist()
        return [min(int(d), 2**63 - 1) for d in ((self.n * y.astype(object) - rest.astype(object)) ** 2).sum(1)]


def covariance(n: int, sums: list[int], moments: np.ndarray) -> np.ndarray:
    """(n * moments - sums x sums) / n^2, each entry rounded once; sums and moments are exact integers about one shift."""
    d = len(sums)
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i + 1):
            out[i, j] = out[j, i] = float(Fraction(n * int(moments[i, j]) - sums[i] * sums[j], n * n))
    return out


def fit_whitening(distinct: DataFrame, most: int = 16) -> Whitening | None:
    """Fit on the rows of a stored table of distinct integer vectors `x` of one length; None if there is none.

    Numbers alone come to the driver: the sums, and as many second moments as the dimension squared."""
    size = distinct.agg(F.count("*"), F.max(F.size("x"))).first()
    n, d = int(size[0]), int(size[1] or 0)
    if not n or not d:
        return None
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; the covariance of at most {MOST_DIMENSIONS} is sent to each task")
    first = _summed(distinct, lambda column: _array(column, d).astype(object).sum(0))
    sums = [first[k] for k in range(d)]
    fitted = Whitening(n, sums, np.zeros(0), np.zeros((0, d)), np.zeros(0))
    shift, upper = fitted.shift, np.triu_indices(d)

    def products(column: pa.Array) -> np.ndarray:
        y = _array(column, d) - shift
        exact = _exactly(y, len(y))
        return (exact.T @ exact)[upper]

    cells = _summed(distinct, products)
    moments = np.zeros((d, d), object)
    moments[upper] = [cells[k] for k in range(len(upper[0]))]
    moments = moments + np.triu(moments, 1).T
    v = covariance(n, [s % n for s in sums], moments)
    fitted.values, fitted.components = principal_components(distinct.sparkSession, v, most)
    fitted.explained = fitted.values / np.trace(v) if len(fitted.values) else fitted.values
    fitted.error = _identity_error(distinct, fitted)
    return fitted


def _identity_error(distinct: DataFrame, fitted: Whitening) -> float:
    """The whitened vectors' own covariance against the identity, in a pass of its own over all of them."""
    k, d = fitted.components.shape
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            z = fitted.whiten(_array(batch.column(0), d))
            total += np.r_[z.sum(0), (z.T @ z).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["cell", "sum"])

    cells = distinct.mapInArrow(run, "cell int, sum double").groupBy("cell").agg(F.sum("sum").alias("sum")).toArrow()
    total = np.zeros(k + k * k)
    total[cells.column("cell").to_numpy()] = cells.column("sum").to_numpy()
    mean = total[:k] / fitted.n  # of values centred before: zero but for rounding
    return float(np.abs(total[k:].reshape(k, k) / fitted.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, most: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row and component: the id, `component` (int, from 1), `n`, `deviation` (long), `whitened`, `explained`
    and `identity_error` (double).

    Entries become floor(scale * x) + offset. Rows whose vector is null or holds a null, NaN or infinity are left
    out; entries beyond 2**44 count as that. Vectors must be of one length to have a covariance: those of the
    length that most distinct vectors have take part (of several the shortest), others and empty ones are left out. Each
    distinct vector is fitted once; all rows, repeated ones and those without an id too, are whitened. Directions without
    variance are no components, so a table of one distinct vector, or an empty one, gives no rows. Other columns
    are left out. Deviations beyond long are held to its range.
    """
    ids = field(df, id_col)
    whole = df.select(F.col(id_col).alias("id"), integer_vector(F.col(vector_col), scale, offset).alias("x")).where("size(x) > 0")
    distinct = store(whole.groupBy("x").agg(F.count("*").alias("n")), "distinct")
    common = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = T.StructType([ids, T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    d = common["d"] if common else 0
    fitted = fit_whitening(distinct.where(F.size("x") == d).select("x"), most)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    k = len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n and k:
                x = _array(batch.column(1), d)
                rows = pa.array(np.repeat(np.arange(n), k))
                columns = [
                    batch.column(0).take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, fitted.n)), pa.array(fitted.deviation(x), pa.int64()).take(rows),
                    pa.array(fitted.whiten(x).ravel()), pa.array(np.tile(fitted.explained, n)), pa.array(np.full(n * k, fitted.error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return whole.where(F.size("x") == d).select("id", "x").mapInArrow(run, schema)
