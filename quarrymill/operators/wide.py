"""Correlations of many columns: products of column blocks, in tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept

#: Columns of a block, rows of a chunk, and chunks whose products a task sums up at a time.
COLUMNS = 512
ROWS = 512
CHUNKS = 256


def _folded(df: DataFrame, keys: Sequence[str], add: Callable, done: Callable, kind: str) -> DataFrame:
    """For each value of the keys what ``done`` makes of the rows that ``add`` has taken up, one after the other: rows stream through the tasks, and no group is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for f in frames:
            for row in f.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != now:
                    if now is not None:
                        yield done(now, state)
                    now, state = key, None
                state = add(state, row)
        if now is not None:
            yield done(now, state)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, kind)


def _moments(df: DataFrame, vector: str) -> DataFrame:
    """block, n, mean and spread (arrays over the block's columns) in two passes; a task holds the sums of its columns only."""
    size = df.select(F.max(F.size(vector))).first()[0] or 0
    blocks = -(-max(size, 0) // COLUMNS)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, square = 0, np.zeros(size), np.zeros(size)
        for f in frames:
            for i in range(0, len(f), ROWS):
                x = np.stack(f[vector].iloc[i : i + ROWS].to_list()).astype(float)
                m, own = len(x), x.mean(0)
                gap = own - total  # means and squares of two groups of rows become those of both
                square += ((x - own) ** 2).sum(0) + gap**2 * (n * m / (n + m))
                total, n = total + gap * (m / (n + m)), n + m
        if n:
            yield pd.DataFrame({"block": range(blocks), "n": n, "mean": [total[b * COLUMNS : (b + 1) * COLUMNS] for b in range(blocks)], "square": [square[b * COLUMNS : (b + 1) * COLUMNS] for b in range(blocks)]})

    def merged(state, row):
        own = row.n, np.array(row.mean), np.array(row.square)
        if state is None:
            return own
        (n, mean, square), (m, more, sq) = state, own
        gap = more - mean
        return n + m, mean + gap * (m / (n + m)), square + sq + gap**2 * (n * m / (n + m))

    done = lambda key, state: pd.DataFrame({"block": [key[0]], "n": [state[0]], "mean": [state[1]], "square": [state[2]]})
    kind = "block int, n long, mean array<double>, square array<double>"
    return _folded(df.select(vector).mapInPandas(sums, kind), ["block"], merged, done, kind)


def correlated(df: DataFrame, vector: str, most: float, least_variance: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, r) of columns a < b with \\|r\\| above ``most``, and the columns (dim, variance of the sample) that took part, with a variance above ``least_variance``.

    Rows are cut into chunks and chunks into blocks of columns. Each two blocks of a chunk are multiplied, centred and scaled, in the task of their share, and the
    products are summed up; a task holds one product of ``COLUMNS`` by ``COLUMNS`` numbers, whatever the table's width, and only pairs above the bound leave it.
    Rows have one length and no nulls.
    """
    held = df.where(F.col(vector).isNotNull()).select(vector)
    stats = kept(_moments(held, vector))
    each = stats.select("block", "n", F.posexplode(F.arrays_zip("mean", "square")).alias("p", "m")).select((F.col("block") * COLUMNS + F.col("p")).alias("dim"), (F.col("m.square") / F.nullif(F.col("n") - 1, F.lit(0))).alias("variance"))
    dims = each.where(F.col("variance") > F.lit(least_variance if least_variance is not None else 0.0))

    def slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        k = 0
        for f in frames:
            for i in range(0, len(f), ROWS):
                x = np.stack(f[vector].iloc[i : i + ROWS].to_list()).astype(float)
                for block, first in enumerate(range(0, x.shape[1], COLUMNS)):
                    yield pd.DataFrame({"chunk": [(at << 32) + k], "block": [block], "x": [np.ascontiguousarray(x[:, first : first + COLUMNS]).tobytes()], "rows": [len(x)]})
                k += 1

    cut = kept(held.mapInPandas(slices, "chunk long, block int, x binary, rows int"))
    scale = stats.select("block", "mean", F.transform("square", lambda s: F.when(s > 0, 1 / F.sqrt(s)).otherwise(0.0)).alias("scale"))
    side = lambda c: cut.join(scale, "block").select("chunk", F.col("block").alias(c), "rows", F.col("x").alias(f"x{c}"), F.col("mean").alias(f"m{c}"), F.col("scale").alias(f"s{c}"))
    pairs = side("a").join(side("b").drop("rows"), "chunk").where("a <= b")

    def product(total, row):
        x, y = ((np.frombuffer(v).reshape(row.rows, -1) - np.array(m)) * np.array(s) for v, m, s in ((row.xa, row.ma, row.sa), (row.xb, row.mb, row.sb)))
        return x.T @ y if total is None else total + x.T @ y

    def packed(key, total):
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "m": [np.ascontiguousarray(total).tobytes()], "wide": [total.shape[1]]})

    def summed(total, row):
        own = np.frombuffer(row.m).reshape(-1, row.wide)
        return own if total is None else total + own

    def above(key, r):
        i, j = np.nonzero(np.abs(r) > most)
        out = pd.DataFrame({"a": i + key[0] * COLUMNS, "b": j + key[1] * COLUMNS, "r": r[i, j]})
        return out[out["a"] < out["b"]]

    share = F.pmod(F.xxhash64("chunk"), F.lit(max(1, -(-cut.where("block = 0").count() // CHUNKS)))).alias("share")
    shared = _folded(pairs.select("*", share), ["a", "b", "share"], product, packed, "a int, b int, m binary, wide int")
    found = _folded(shared, ["a", "b"], summed, above, "a int, b int, r double")
    part = dims.select("dim")
    return found.join(part.withColumnRenamed("dim", "a"), "a").join(part.withColumnRenamed("dim", "b"), "b").select("a", "b", "r"), dims


def low_value_filter(df: DataFrame, vector: str, least: float, most: float) -> DataFrame:
    """dim of the columns that remain: with a variance above ``least``, and not correlated above ``most`` with any earlier column of such variance."""
    pairs, dims = correlated(df, vector, most, least)
    return dims.select("dim").join(pairs.select(F.col("b").alias("dim")), "dim", "left_anti")
