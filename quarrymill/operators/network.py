"""A multilayer perceptron trained by rounds over a table: gradients are summed up in the tasks and by Spark, and weights are sent back out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept

Weights = list[np.ndarray]
#: Points of a partition, where there are fewer of them than Spark's partitions have room for.
POINTS = 1 << 16


def start(width: int, hidden: int, seed: int) -> Weights:
    """Two hidden layers and an output, drawn by the usual scale for rectifiers."""
    rng = np.random.default_rng(seed)
    draw = lambda a, b: rng.normal(0, np.sqrt(2 / a), (a, b))
    return [draw(width, hidden), np.zeros(hidden), draw(hidden, hidden), np.zeros(hidden), draw(hidden, 1), np.zeros(1)]


def forward(w: Weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hidden layers and the output."""
    h = np.maximum(x @ w[0] + w[1], 0)
    g = np.maximum(h @ w[2] + w[3], 0)
    return h, g, (g @ w[4] + w[5])[:, 0]


def gradient(w: Weights, x: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0) -> np.ndarray:
    """Sum over the rows, each counted n times, of the gradient of half the squared error, all weights in a line; the sum of squared errors comes last."""
    h, g, out = forward(w, x)
    e = (n * (out - y))[:, None]
    dg = (e @ w[4].T) * (g > 0)
    dh = (dg @ w[2].T) * (h > 0)
    parts = [x.T @ dh, dh.sum(0), h.T @ dg, dg.sum(0), g.T @ e, e.sum(0)]
    return np.concatenate([*(p.ravel() for p in parts), [float((n * (out - y) ** 2).sum())]])


def shaped(line: np.ndarray, like: Weights) -> Weights:
    out, at = [], 0
    for w in like:
        out.append(line[at : at + w.size].reshape(w.shape))
        at += w.size
    return out


class Adam:
    """The usual moments of gradients, for the weights in a line."""

    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, line: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * gradient, 0.999 * self.v + 0.001 * gradient**2
        return line - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def points(df: DataFrame, features: str, target: str, fold: str) -> DataFrame:
    """fold, x, n, y, q: rows of one fold and equal features as one, with their number and the means of their targets and of the squares of these."""
    y = F.col(target).cast("double")
    whole = F.count(y) == F.count("*")
    out = kept(df.groupBy(F.col(fold).alias("fold"), F.col(features).alias("x")).agg(F.count("*").cast("double").alias("n"), F.when(whole, F.avg(y)).alias("y"), F.when(whole, F.avg(y * y)).alias("q")))
    return out.coalesce(max(1, -(-out.count() // POINTS)))


def out_of_fold(df: DataFrame, features: str, target: str, fold: str, k: int, hidden: int = 16, rounds: int = 40, rate: float = 0.03, seed: int = 7) -> DataFrame:
    """df with prediction: each row by the network that is trained on the other folds (0 to k - 1, in column ``fold``)."""
    return df.withColumn("prediction", fitted(points(df, features, target, fold), k, hidden, rounds, rate, seed)(features, fold))


def fitted(rows: DataFrame, k: int, hidden: int = 16, rounds: int = 40, rate: float = 0.03, seed: int = 7) -> Callable[[str, str], Column]:
    """The prediction, of features and fold, by the network that is trained on the other folds (0 to k - 1) of ``points``.

    All k networks are trained in the same rounds: a point adds to the gradients of all but its own fold's, as often as it stands for a row; the squared errors of
    rows with equal features have the gradient of their mean. Features and target are scaled by the means and deviations of a network's own rows.
    What goes through the driver are k sets of weights. Features have one length and no nulls.
    """
    width = rows.select(F.size("x")).first()[0]
    if width < 0:
        width = 0
    value = lambda i: F.get("x", F.lit(i)).cast("double")
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias(f"s{width}"), F.sum(F.col("n") * F.col("q")).alias(f"q{width}")]
    sums += [c for i in range(width) for c in (F.sum(F.col("n") * value(i)).alias(f"s{i}"), F.sum(F.col("n") * value(i) * value(i)).alias(f"q{i}"))]
    of = {r.fold: r for r in rows.groupBy("fold").agg(*sums).collect()}  # k rows
    scales = []
    for i in range(k):
        n = max(1, sum(r.n for f, r in of.items() if f != i))
        mean = np.array([sum(r[f"s{j}"] or 0.0 for f, r in of.items() if f != i) / n for j in range(width + 1)], float)
        square = np.array([sum(r[f"q{j}"] or 0.0 for f, r in of.items() if f != i) / n for j in range(width + 1)], float)
        spread = np.sqrt(np.maximum(square - mean**2, 0))
        scales.append((n, mean, np.where(spread > 0, spread, 1.0)))
    like = start(width, hidden, seed)
    lines = [np.concatenate([w.ravel() for w in start(width, hidden, seed + i)]) for i in range(k)]
    moments = [Adam(len(lines[0]), rate) for _ in range(k)]

    def scaled(i: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, mean, spread = scales[i]
        return (x - mean[:-1]) / spread[:-1], (y - mean[-1]) / spread[-1]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
                y, own, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "fold", "n"))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y, own, n)], names=["x", "y", "fold", "n"])

    def gradients(weights: list[Weights]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: list = [0.0] * k
            for batch in batches:
                for cells in batch.to_pylist():
                    y, own, n = (np.frombuffer(cells[c]) for c in ("y", "fold", "n"))
                    x = np.frombuffer(cells["x"]).reshape(len(y), -1)
                    for i in range(k):
                        rest = own != i
                        if rest.any():
                            total[i] = total[i] + gradient(weights[i], *scaled(i, x[rest], y[rest]), n[rest])
            for i, line in enumerate(total):
                if isinstance(line, np.ndarray):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(line), i, np.int32)), pa.array(np.arange(len(line), dtype=np.int32)), pa.array(line)], names=["model", "at", "g"])

        return run

    # the rounds read matrices; rows are taken apart once
    held = kept(rows.select("x", "y", F.col("fold").cast("double").alias("fold"), "n").mapInArrow(packed, "x binary, y binary, fold binary, n binary"))
    for _ in range(rounds):
        summed = held.mapInArrow(gradients([shaped(line, like) for line in lines]), "model int, at int, g double").groupBy("model", "at").agg(F.sum("g").alias("g"))
        all_ = np.zeros((k, len(lines[0]) + 1))
        for r in summed.collect():  # as many rows as weights
            all_[r.model, r["at"]] = r.g
        lines = [m.step(line, g[:-1] / s[0]) for m, line, g, s in zip(moments, lines, all_, scales, strict=True)]
    ready = [shaped(line, like) for line in lines]

    @F.pandas_udf("double")
    def predicted(x: pd.Series, own: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        each, own = np.stack(x.to_list()).astype(float), own.to_numpy()
        out = np.zeros(len(each))
        for i in range(k):
            if (own == i).any():
                _, mean, spread = scales[i]
                out[own == i] = forward(ready[i], (each[own == i] - mean[:-1]) / spread[:-1])[2] * spread[-1] + mean[-1]
        return pd.Series(out)

    return predicted
