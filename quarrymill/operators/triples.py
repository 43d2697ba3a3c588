"""Embeddings of (head, relation, tail) triples, trained and scored over tables.

Heads and tails are dealt to buckets by hash, and triples to the block of their head's and their tail's bucket. A turn trains blocks
that share no bucket at the same time, each in a task that holds the vectors of its two buckets and its triples; as many turns as there are buckets
see every block, and several visits of all turns are made. Vectors live in a table that is written after each turn. The
vectors of relations, a handful by nature, are moved by the mean of what the blocks ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Rounds, kept

#: Heads or tails of a bucket on average, and vectors that are scored at a time.
BUCKET = 20_000
BLOCK = 1024
#: A triple's step is one part of all triples, of so many at least: few triples must not make large steps.
LEAST = 100


def start(key: str | Column, side: str, size: int, seed: int) -> Column:
    """The first vector of a name, drawn from its hash: even in -0.5 to 0.5."""
    unit = lambda k: F.pmod(F.xxhash64(key, F.lit(side), k, F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0) - 0.5
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), unit)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def steps(a: np.ndarray, b: np.ndarray, r: np.ndarray, triples: np.ndarray, kind: str, n: int, share: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heads a, tails b and relations r after n steps over all triples (rows of places in a, r, b), each with one drawn false tail; a triple's step counts by ``share``."""
    for _ in range(n):
        false = triples.copy()
        false[:, 2] = rng.integers(0, len(b), len(triples))
        for rows, label in ((triples, 1.0), (false, 0.0)):
            u, v, w = a[rows[:, 0]], r[rows[:, 1]], b[rows[:, 2]]
            if kind == "transe":
                gap = u + v - w
                step = (1 / (1 + np.exp(np.abs(gap).sum(1))) - label)[:, None] * share * 2 * -np.sign(gap)
                np.add.at(a, rows[:, 0], -step)
                np.add.at(b, rows[:, 2], step)
                np.add.at(r, rows[:, 1], -step * 0.05)
                a, b = unit(a), unit(b)
            else:
                g = (1 / (1 + np.exp(-(u * v * w).sum(1))) - label)[:, None] * share * 20
                np.add.at(a, rows[:, 0], -g * v * w)
                np.add.at(b, rows[:, 2], -g * v * u)
                np.add.at(r, rows[:, 1], -g * u * w * 0.005)
    return a, b, r


def buckets_of(triples: DataFrame, most: int = BUCKET) -> int:
    """Buckets for the larger of the two sides; only counts come to the driver."""
    n = triples.agg(F.countDistinct("head"), F.countDistinct("tail")).first()
    return max(1, -(-max(n) // most))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _block(held: dict[str, np.ndarray], turn: int, kind: str, local_steps: int, share: float, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a task does with the heads, tails and triples of one block: their vectors after some steps, and how relations moved."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        slot = int(pdf["slot"].iloc[0])
        sides = {s: pdf[pdf["side"] == s].sort_values("name", ignore_index=True) for s in ("head", "tail")}
        x = pdf[pdf["side"] == "triple"].sort_values(["name", "relation", "other"])
        if not len(x):
            return pd.concat(sides.values())[["side", "name", "vector", "bucket"]]
        a, b = (np.stack(sides[s]["vector"].to_list()).astype(float) for s in ("head", "tail"))
        order = sorted(held)
        place = [pd.Index(sides["head"]["name"]).get_indexer(x["name"]), pd.Index(order).get_indexer(x["relation"]), pd.Index(sides["tail"]["name"]).get_indexer(x["other"])]
        r = np.stack([held[k] for k in order])
        a, b, moved = steps(a, b, r.copy(), np.stack(place, 1), kind, local_steps, share, np.random.default_rng((seed, turn, slot)))
        sides["head"]["vector"], sides["tail"]["vector"] = list(a), list(b)
        more = pd.DataFrame({"side": "relation", "name": order, "vector": list(moved - r), "bucket": slot})
        return pd.concat([*sides.values(), more])[["side", "name", "vector", "bucket"]]

    return run


def train(triples: DataFrame, kind: str = "distmult", size: int = 16, visits: int = 6, local_steps: int = 10, seed: int = 13, bucket: int = BUCKET) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """side ('head' or 'tail'), name, vector of every head and tail, and the vector of each relation."""
    tables = Rounds(triples.sparkSession)
    rows = tables.saved("rows", triples.select("head", "relation", "tail").distinct())
    n, share = buckets_of(rows, bucket), 1 / max(LEAST, rows.count())
    names = rows.select(F.lit("head").alias("side"), F.col("head").alias("name")).unionByName(rows.select(F.lit("tail").alias("side"), F.col("tail").alias("name"))).distinct()
    vectors = tables.saved("vectors", names.withColumn("vector", start("name", "", size, seed)).withColumn("bucket", _bucket("name", n)))
    known = sorted(r.relation for r in rows.select("relation").distinct().collect())  # relations are a handful
    relations = {x: np.full(size, 1.0 if kind == "distmult" else 0.0) for x in known}
    placed = tables.saved("placed", rows.select(F.lit("triple").alias("side"), F.col("head").alias("name"), "relation", F.col("tail").alias("other"), _bucket("head", n).alias("a"), _bucket("tail", n).alias("b")))
    columns = ["side", "name", "relation", "other", "vector", "bucket", "slot"]
    for turn in range(visits * n):
        shift = turn % n
        slot = F.when(F.col("side") == "head", F.col("bucket")).otherwise(F.pmod(F.col("bucket") - shift, F.lit(n)))
        none = lambda t: F.lit(None).cast(t)
        own = vectors.select("side", "name", none("string").alias("relation"), none("string").alias("other"), "vector", "bucket", slot.alias("slot"))
        now = placed.where(F.pmod(F.col("b") - F.col("a"), F.lit(n)) == shift).select("side", "name", "relation", "other", none("array<double>").alias("vector"), F.col("a").alias("bucket"), F.col("a").alias("slot"))
        after = tables.saved("vectors", own.unionByName(now).select(*columns).groupBy("slot").applyInPandas(_block(dict(relations), turn, kind, local_steps, share, seed), "side string, name string, vector array<double>, bucket int"))
        asked = after.where("side = 'relation'").groupBy("name").agg(F.array(*(F.avg(F.col("vector")[i]) for i in range(size))).alias("vector"))
        for m in asked.collect():  # one row for each relation
            relations[m.name] = relations[m.name] + np.array(m.vector)
        vectors = after.where("side <> 'relation'")
    out = kept(vectors.select("side", "name", "vector"))
    tables.dropped()
    return out, relations


def best_tails(vectors: DataFrame, relation: np.ndarray, kind: str, k: int) -> DataFrame:
    """head, tail, score, rank: the k tails of the highest score for each head; scores are scaled to 0..1 within each tail.

    Blocks of heads meet blocks of tails, and a meeting gives the lowest and highest score of each tail, and after that the k best
    tails of each head: never all pairs.
    """
    size = len(relation)

    def packed(side: str, block: str) -> DataFrame:
        own = vectors.where(F.col("side") == side)
        parts = max(1, -(-own.count() // BLOCK))
        return own.groupBy(F.pmod(F.xxhash64("name", F.lit(7)), F.lit(parts)).alias(block)).agg(F.sort_array(F.collect_list(F.struct("name", "vector"))).alias(side))

    heads, tails = kept(packed("head", "h")), kept(packed("tail", "t"))
    blocks = [r.t for r in tails.select("t").collect()]  # a number for each block of tails
    meet = lambda t: heads.withColumn("t", F.explode(F.array(*map(F.lit, blocks)))).join(t, "t")

    def raw(heads: list, tails: list) -> np.ndarray:
        a, b = (np.array([x["vector"] for x in side], float).reshape(-1, size) for side in (heads, tails))
        if kind == "distmult":
            return (a * relation) @ b.T
        a = a + relation
        return -np.stack([np.abs(a - w).sum(1) for w in b], 1)

    def spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for h, t in zip(f["head"], f["tail"], strict=True):
                m = raw(h, t)
                yield pd.DataFrame({"tail": [x["name"] for x in t], "low": m.min(0), "high": m.max(0)})

    def tops(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for h, t, s in zip(f["head"], f["tail"], f["spans"], strict=True):
                of = {x["tail"]: (x["low"], x["high"]) for x in s}
                low, high = np.array([of[x["name"]] for x in t]).T
                m = np.where(high > low, (raw(h, t) - low) / np.where(high > low, high - low, 1), 0.5).round(6)
                order = np.argsort(-m, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"head": np.repeat([x["name"] for x in h], order.shape[1]), "tail": np.array([x["name"] for x in t])[order.reshape(-1)], "score": np.take_along_axis(m, order, 1).reshape(-1)})

    if not blocks:
        return vectors.select(F.col("name").alias("head"), F.col("name").alias("tail"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    span = meet(tails).select("head", "tail").mapInPandas(spans, "tail string, low double, high double").groupBy("tail").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    by_block = tails.select("t", F.explode("tail").alias("x")).select("t", F.col("x.name").alias("tail")).join(span, "tail").groupBy("t").agg(F.collect_list(F.struct("tail", "low", "high")).alias("spans"))
    found = meet(tails.join(kept(by_block), "t")).select("head", "tail", "spans").mapInPandas(tops, "head string, tail string, score double")
    rank = F.row_number().over(Window.partitionBy("head").orderBy(F.desc("score"), "tail"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
