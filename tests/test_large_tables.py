"""Steps that must not grow faster than their tables: what meets in one task, and what is shuffled."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import relational as R
from quarrymill.operators import models, nearest, search, stats, ward


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shape", ["normal", "lattice", "far"])
def test_partners_equal_all_pairs(shape):
    rng = np.random.default_rng(1)
    x = {"normal": rng.normal(0, 1, (600, 7)), "lattice": rng.integers(0, 3, (600, 4)).astype(float), "far": rng.normal(1e6, 1e-2, (600, 3))}[shape]
    n = rng.integers(1, 5, (600, 1)).astype(float)
    ids = np.arange(600) * 3
    got = ward._partners([ids[100:300], n[100:300], x[100:300]], [ids, n, x]).to_pylist()
    assert [r["id"] for r in got] == ids[100:300].tolist()
    for k, r in enumerate(got, 100):
        cost = ward._exact(x[k], x) * (2 * n[k, 0] * n[:, 0] / (n[k, 0] + n[:, 0]))
        cost[k] = np.inf
        best = min((cost[j], min(ids[k], ids[j]), max(ids[k], ids[j])) for j in range(600))
        assert (r["cost"], r["a"], r["b"]) == best


def test_blocks_are_few():
    """A table is sent as often as it has blocks: 8 times for 100,000 rows, where blocks of 512 made it 100 times and more."""
    assert ward._parts(100_000) == 8 and ward._parts(600_000) == 37 and ward._parts(1) == 1


def test_pairs_need_no_distinct(spark):
    rng = random.Random(3)
    a = [(rng.choice([*range(40), None]), rng.choice(["x", "y", None]), rng.choice(["u", "v", "w", None])) for _ in range(120)]
    b = [(rng.choice([*range(30), None]), rng.choice(["x", "y", "u", None]), rng.choice(["u", "v", "x", None])) for _ in range(90)]
    left, right = spark.createDataFrame(a, "i long, p string, q string"), spark.createDataFrame(b, "j long, r string, s string")
    df = R.either_key_join(left, right, [(left.p, right.r), (left.q, right.s)], ["i"], ["j"])
    got = [tuple(r) for r in df.collect()]
    want = {(i, j) for i, p, q in a for j, r, s in b if (p is not None and p == r) or (q is not None and q == s)}
    assert len(got) == len(set(got)) and set(got) == want
    above = plan(df).split("Join", 1)[0]
    assert "Exchange" not in above and "Aggregate" not in above


def test_percentiles_by_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice([rng.random(), 0.5, 2.0, None]),) for _ in range(501)]
    df = spark.createDataFrame(rows, "v double")
    levels = [0.0, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    got = stats.percentiles(df, "v", levels)
    assert got.first().q == pytest.approx(np.quantile([v for (v,) in rows if v is not None], levels).tolist())
    assert "percentile" not in plan(got)
    assert stats.percentiles(df.where("v > 5"), "v", [0.5, 0.6]).first().q == [None, None]
    assert stats.percentiles(df.where(F.col("v") == 2.0).limit(1), "v", [0.5]).first().q == [2.0]


def test_equal_tables_are_tested_once():
    stats.fisher_greater.cache_clear()
    for _ in range(1000):
        stats.fisher_greater(1, 2, 3, 19994)
    assert stats.fisher_greater.cache_info().misses == 1


def test_postings_are_counted_in_place(spark):
    docs = spark.createDataFrame([(1, "a x b x", "y"), (2, None, "y y"), (2, "x", None), (None, "z z", "q")], "k long, t string, u string")
    df = search.index(docs, "k", {"t": 1.0, "u": 2.0}, stop=())
    assert plan(df).count("Exchange") == 1
    assert sorted(tuple(str(v) for v in (r.field, r.k, r.term, r.tf, r.len)) for r in df.collect()) == sorted(
        tuple(str(v) for v in r)
        for r in [("t", 1, "a", 1, 4), ("t", 1, "x", 2, 4), ("t", 1, "b", 1, 4), ("u", 1, "y", 1, 1), ("u", 2, "y", 2, 2), ("t", 2, "x", 1, 1), ("t", None, "z", 2, 2), ("u", None, "q", 1, 1)]
    )


def test_vectors_of_a_hot_pivot(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 50)
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (400, 5)).round(1)
    x[200:300] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    out = nearest.nearest_vectors(df, "id", "v", F.col("id") % 10 == 0, pivots=3)
    plans = plan(out)
    assert "CoGroupedArrow" in plans or "FlatMapCoGroupsInArrow" in plans
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    for r in out.collect():
        cos = np.round(unit @ unit[r.query], 6)
        cos[r.query] = -2
        assert r.cosine == pytest.approx(cos.max(), abs=2e-6) and abs(cos[r.id] - cos.max()) <= 1.1e-6


def test_grades_of_equal_links_are_one_test(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(models, "fisher_greater", lambda *t: calls.append(t) or stats.fisher_greater(*t))
    s, a, b = np.tile([1, 2, 3], 50), np.tile([3, 3, 4], 50), np.tile([9, 7, 8], 50)
    got = models.fisher_udf().func(pd.Series(s), pd.Series(a), pd.Series(b), pd.Series(np.full(150, 20000)))
    assert got.tolist() == [stats.fisher_greater(int(x), int(y - x), int(z - x), int(20000 - y - z + x)) for x, y, z in zip(s, a, b, strict=True)]
    assert len(calls) == 3 and len(models.fisher_udf().func(*[pd.Series([], dtype=int)] * 4)) == 0


def test_partners_by_single_precision(monkeypatch):
    """Rows apart go by single precision only; where it tells too few apart, by double precision, with the same partners."""
    rng, kinds = np.random.default_rng(12), []
    right = ward._right
    monkeypatch.setattr(ward, "_right", lambda b, kind: kinds.append(kind) or right(b, kind))
    ids, one = np.arange(500), np.ones((500, 1))
    for x, want in ((rng.normal(1e4, 1, (500, 16)), [np.float32]), (np.concatenate([rng.normal(0, 1e-6, (499, 16)), np.full((1, 16), 1e3)]), [np.float32, float])):
        kinds.clear()
        got = ward._partners([ids, one, x], [ids, one, x]).to_pydict()
        cost = np.stack([ward._exact(row, x) for row in x])
        np.fill_diagonal(cost, np.inf)
        assert kinds == want and got["id"] == ids.tolist() and got["cost"] == cost.min(1).tolist()
