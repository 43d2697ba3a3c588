"""Operator 13: whitening of embeddings by a compensated covariance.

* A component c becomes x = floor(64 * c) + 1,000,000, so that sums are exact. The model is fitted on each distinct vector once.
* Vectors are centred first: S / n, exact sums over their number, is kept as a high and a low double, and so is x - S / n.
* Outer products are accumulated by error-free transformations: the centred numbers of a block of rows are split into three
  slices of 21 bits below the block's largest number, so that the product of any two slices over the block is exact in doubles, and the
  exact products are added to a sum of high and low parts by two-sums. Tasks give high and low parts, which are merged in
  pairs the same way, ``FAN_IN`` tasks at a time, level by level.
* Eigenvectors come from LAPACK's dsyevd (``numpy.linalg.eigh``), which reduces to tridiagonal form and divides and conquers.
  The covariance is as wide as the vectors, whatever the table holds, so this is done on the driver.
* The covariance of the whitened vectors is measured over all distinct vectors by the same accumulation.

Rows whose vector is null, empty, or holds nulls, NaN or infinities are dropped, as are those with another length than the vector of the
smallest kept id. Components beyond ``MOST`` / 64 count as that bound. Repeated rows are rows of their own in the result and one in the fit.
Components whose eigenvalue is zero to double precision cannot be whitened and have no rows; so a table of one vector gives none, as does an empty one.
A deviation beyond 64 bits is null. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import removed, written_at
from ._vectors import blocks, first_width, integers, matrix

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Components beyond this count as this; integers up to here are exact in doubles.
MOST = float(1 << 52)
#: Tasks whose parts are merged in one.
FAN_IN = 32
#: Rows of a block: 2 * 21 bits of a product and 10 of the rows' number fit a double's 53.
_ROWS = 1024
_BITS = 21


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and what rounding lost, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def added(high: np.ndarray, low: np.ndarray, h: np.ndarray, l: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two numbers of high and low parts."""
    s, e = two_sum(high, h)
    t, f = two_sum(low, np.broadcast_to(l, low.shape))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x - mean as high and low parts."""
    s, e = two_sum(x.astype(np.float64), -mean[0])
    return two_sum(s, e - mean[1])


def gram(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the outer products of a block's rows, as high and low parts."""
    top = float(np.abs(high).max(initial=0.0))
    total = np.zeros((high.shape[1],) * 2), np.zeros((high.shape[1],) * 2)
    if top == 0.0:
        return total
    unit = 2.0 ** (np.frexp(top)[1] - _BITS)
    slices, rest, under = [], high, low
    for k in range(3):
        one = unit * 2.0 ** (-_BITS * k)
        if k == 2:
            rest = rest + under
        cut = np.rint(rest / one) * one
        slices.append(cut)
        rest = rest - cut
    for i, j in ((0, 0), (0, 1), (1, 1), (0, 2), (1, 2)):
        product = slices[i].T @ slices[j]
        total = added(*total, product)
        if i != j:
            total = added(*total, product.T)
    return total


def _parts(rows: DataFrame, of_block: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the outer products over all tasks; of_block gives a block's centred rows as high and low parts."""
    upper = np.triu_indices(width)

    def row(high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a))
        return pa.RecordBatch.from_arrays([one(high), one(low)], names=["high", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in blocks(batches, _ROWS):
            own = gram(*of_block(part))
            total = own if total is None else added(*total, *own)
        if total:
            yield row(total[0][upper], total[1][upper])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                own = tuple(batch.column(c).slice(i, 1).flatten().to_numpy() for c in ("high", "low"))
                total = own if total is None else added(*total, *own)
        if total:
            yield row(*total)

    kind = "high array<double>, low array<double>"
    found = rows.mapInArrow(run, kind)
    tasks = rows.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        found = found.repartition(tasks).mapInArrow(merge, kind)
    out = np.zeros((width, width)), np.zeros((width, width))
    for r in found.collect():  # one row
        for m, values in zip(out, (r.high, r.low), strict=True):
            m[upper] = values
            m.T[upper] = values
    return out


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for part in blocks(batches, 512):  # 512 numbers below 2 ** 53 fit 64 bits
            n += part.num_rows
            total = [a + b for a, b in zip(total, matrix(part, "x", width).sum(0).tolist(), strict=True)]
        if n:
            base = 1 << 40
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(width)]), pa.array([n, *(v // base for v in total)]), pa.array([0, *(v % base for v in total)])], names=["dim", "high", "low"])

    rows = fit.mapInArrow(run, "dim long, high long, low long").groupBy("dim").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # a row for each dimension
    of = {r.dim: r.high * (1 << 40 if r.dim >= 0 else 1) + r.low for r in rows}
    return of.get(-1, 0), [of.get(i, 0) for i in range(width)]


class Model:
    """n, sums and mean of the fitted vectors; their covariance, its positive eigenvalues (falling) and vectors. Sent to the tasks."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        exact = [Fraction(s, n) for s in sums]
        high = [float(f) for f in exact]
        self.mean = np.array(high), np.array([float(f - Fraction(h)) for f, h in zip(exact, high, strict=True)])
        self.error = 0.0

    def solve(self, outer: tuple[np.ndarray, np.ndarray], components: int) -> None:
        """Eigenvalues and vectors of the covariance."""
        s = outer[0] / self.n
        self.covariance = s + outer[1] / self.n
        values, vectors = np.linalg.eigh(self.covariance)
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > len(values) * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)]
        self.values, self.vectors = values[order], vectors[:, order]
        trace = float(np.trace(self.covariance))
        self.explained = self.values / trace if trace > 0 else self.values

    def whitened(self, x: np.ndarray) -> np.ndarray:
        high, low = centred(x, self.mean)
        return ((high + low) @ self.vectors) / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 over the dimensions, exact; null beyond 64 bits."""
        near = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s - self.n * m for s, m in zip(self.sums, near.tolist(), strict=True)]
        off = x - near
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if most * most * len(rest) < 1 << 63:
            return ((self.n * off - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        out = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in off.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Model | None:
    """The model of the distinct vectors of column x; null without rows."""
    spark = rows.sparkSession
    distinct, path = written_at(rows.select("x").distinct())
    n, sums = _sums(distinct, width)
    if not n:
        removed(spark, path)
        return None
    model = Model(n, sums)
    sent = spark.sparkContext.broadcast(model)
    model.solve(_parts(distinct, lambda part: centred(matrix(part, "x", width), sent.value.mean), width), components)
    if k := len(model.values):
        solved = spark.sparkContext.broadcast(model)
        outer = _parts(distinct, lambda part: (w := solved.value.whitened(matrix(part, "x", width)), np.zeros_like(w)), k)
        model.error = float(np.abs(outer[0] / n + outer[1] / n - np.eye(k)).max())
    removed(spark, path)
    return model


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each kept row and component."""
    rows = integers(vectors, SCALE, OFFSET, MOST, vector, "x", F.col(id_).alias("vec_id"))
    width = first_width(rows, "vec_id", "x")
    rows = rows.where(F.size("x") == width)
    model = fit(rows, width, components) if width else None
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        k = len(model.values) if model else 0
        for part in blocks(batches, _ROWS) if k else ():
            x = matrix(part, "x", width)
            m, size = len(x), len(x) * k
            again = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(size, model.n)), pa.array(model.deviation(x), pa.int64()).take(pa.array(again)),
                    pa.array(model.whitened(x).reshape(-1)), pa.array(np.tile(model.explained, m)), pa.array(np.full(size, model.error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
