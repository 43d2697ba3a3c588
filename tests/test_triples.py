"""Triples trained block by block against one loop in numpy, and their best tails against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quarrymill.operators import triples as T


def table(spark, n=120, seed=1):
    rng = random.Random(seed)
    rows = {(f"h{rng.randrange(12)}", f"r{rng.randrange(2)}", f"t{rng.randrange(9)}") for _ in range(n)}
    return spark.createDataFrame(sorted(rows), "head string, relation string, tail string"), sorted(rows)


def first(spark, names, size, seed):
    df = spark.createDataFrame([(x,) for x in names], "name string")
    return {r.name: np.array(r.v) for r in df.select("name", T.start("name", "", size, seed).alias("v")).collect()}


@pytest.mark.parametrize("kind", ["distmult", "transe"])
def test_one_bucket_equals_a_loop(spark, kind):
    df, rows = table(spark)
    heads, tails, relations = (sorted({r[i] for r in rows}) for i in (0, 2, 1))
    drawn = first(spark, heads + tails, 6, 13)
    a, b = np.stack([drawn[x] for x in heads]), np.stack([drawn[x] for x in tails])
    r = np.full((len(relations), 6), 1.0 if kind == "distmult" else 0.0)
    places = np.array([(heads.index(x), relations.index(y), tails.index(z)) for x, y, z in rows])
    for turn in range(2):
        a, b, r = T.steps(a, b, r, places, kind, 5, 1 / 100, np.random.default_rng((13, turn, 0)))
    vectors, found = T.train(df, kind, size=6, visits=2, local_steps=5)
    got = {(x.side, x.name): x.vector for x in vectors.collect()}
    assert set(got) == {("head", x) for x in heads} | {("tail", x) for x in tails}
    assert np.allclose([got["head", x] for x in heads], a) and np.allclose([got["tail", x] for x in tails], b)
    assert np.allclose([found[x] for x in relations], r)
    scores = (a * r[0]) @ b.T if kind == "distmult" else -np.abs((a + r[0])[:, None] - b[None]).sum(2)
    scaled = ((scores - scores.min(0)) / (scores.max(0) - scores.min(0))).round(6)
    best = T.best_tails(vectors, found[relations[0]], kind, 3).collect()
    assert len(best) == 3 * len(heads)
    for x in best:
        i = heads.index(x.head)
        order = sorted((-s, t) for s, t in zip(scaled[i], tails, strict=True))
        assert (pytest.approx(-x.score), x.tail) == order[x["rank"] - 1]


def test_buckets_learn_what_one_loop_learns(spark):
    """Two groups of names that only join their own kind; every bucket has some of both."""
    rows = [(f"h{g}{i}", "r", f"t{g}{j}") for g in "xy" for i in range(12) for j in range(8) if (i * 7 + j * 3) % 4]
    df = spark.createDataFrame(rows, "head string, relation string, tail string")
    vectors, relations = T.train(df, visits=8, local_steps=10, bucket=5)
    held = {(v.side, v.name): np.array(v.vector) for v in vectors.collect()}
    assert len(held) == 40
    right = wrong = 0.0
    for h in (k[1] for k in held if k[0] == "head"):
        for t in (k[1] for k in held if k[0] == "tail"):
            s = float((held["head", h] * relations["r"] * held["tail", t]).sum())
            right, wrong = (right + s, wrong) if h[1] == t[1] else (right, wrong + s)
    assert right > wrong + 50


def test_blocks_of_vectors_give_the_same_tails(spark, monkeypatch):
    df, _ = table(spark, 200, 3)
    vectors, relations = T.train(df, size=4, visits=1, local_steps=3)
    want = {(x.head, x.tail, x.score, x["rank"]) for x in T.best_tails(vectors, relations["r0"], "distmult", 4).collect()}
    monkeypatch.setattr(T, "BLOCK", 3)
    assert {(x.head, x.tail, x.score, x["rank"]) for x in T.best_tails(vectors, relations["r0"], "distmult", 4).collect()} == want


def test_no_triples(spark):
    vectors, relations = T.train(spark.createDataFrame([], "head string, relation string, tail string"))
    assert vectors.count() == 0 and relations == {} and T.best_tails(vectors, np.ones(3), "distmult", 2).count() == 0
