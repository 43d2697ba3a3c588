"""Ward's trees, silhouettes, wide correlations and networks against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import models, network, vectors, ward, wide
from quarrymill.operators.scoring import folds
from quarrymill.plans import registry

FOLDER = "/root/testdata/sf0.01"


def plain_tree(x):
    """Merges by the cheapest pair of all, one at a time."""
    held = {i: (1.0, v.astype(float)) for i, v in enumerate(x)}
    out = []
    ids = np.arange(len(x))
    n, c = np.ones(len(x)), x.astype(float).copy()
    alive = np.ones(len(x), bool)
    cost = ((c[:, None] - c[None]) ** 2).sum(2)
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(held) - 1):
        i, j = sorted(divmod(int(cost.argmin()), len(x)))
        out.append((int(ids[i]), int(ids[j]), float(np.sqrt(cost[i, j]))))
        c[i], n[i] = (c[i] * n[i] + c[j] * n[j]) / (n[i] + n[j]), n[i] + n[j]
        alive[j] = False
        row = ((c - c[i]) ** 2).sum(1) * 2 * n * n[i] / (n + n[i])
        row[~alive], row[i] = np.inf, np.inf
        cost[j], cost[:, j], cost[i], cost[:, i] = np.inf, np.inf, row, row
    return out


@pytest.mark.parametrize(("n", "last"), [(500, 256), (160, 8)])
def test_tree_equals_plain_ward(spark, monkeypatch, n, last):
    monkeypatch.setattr(ward, "LAST", last)
    monkeypatch.setattr(ward, "BLOCK", 64)
    x = np.random.default_rng(n).normal(0, 1, (n, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 6), (9999, None)], "id long, v array<double>")
    got = ward.tree(df, "id", "v").collect()
    want = plain_tree(x)
    assert len(got) == n - 1
    assert np.allclose(sorted(r.height for r in got), sorted(h for _, _, h in want))
    assert {(r.a, r.b) for r in got} == {(a, b) for a, b, _ in want}


def test_equal_rows_are_merged_first(spark, monkeypatch):
    monkeypatch.setattr(ward, "LAST", 2)
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(300 + i, [float(i), -5.0]) for i in range(9)]
    got = ward.tree(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v").collect()
    assert len(got) == 308 and sum(r.height == 0 for r in got) == 299
    assert ward.tree(spark.createDataFrame(rows[:1], "id long, v array<double>"), "id", "v").count() == 0
    assert ward.tree(spark.createDataFrame([], "id long, v array<double>"), "id", "v").count() == 0


def test_cuts_and_scores(spark):
    x = np.array([r.embedding for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()], float)
    merges = sorted(plain_tree(x), key=lambda m: m[2])
    for r in registry.queries()["ds22_ward_cuts"](spark, FOLDER).collect():
        k, root = r.k, list(range(len(x)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b, _ in merges[: len(x) - k]:
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
        label = np.array([find(i) for i in range(len(x))])
        assert r.silhouette == pytest.approx(silhouette(x, label), abs=1e-6)
        groups = [x[label == c] for c in sorted(set(label.tolist()))]
        means = [g.mean(0) for g in groups]
        within = sum(((g - m) ** 2).sum() for g, m in zip(groups, means, strict=True))
        between = sum(len(g) * ((m - x.mean(0)) ** 2).sum() for g, m in zip(groups, means, strict=True))
        assert r.calinski_harabasz == pytest.approx(between / (k - 1) / (within / (len(x) - k)), rel=1e-5)
        spread = [np.sqrt(((g - m) ** 2).sum(1)).mean() for g, m in zip(groups, means, strict=True)]
        worst = [max((spread[i] + spread[j]) / np.linalg.norm(means[i] - means[j]) for j in range(k) if j != i) for i in range(k)]
        assert r.davies_bouldin == pytest.approx(np.mean(worst), rel=1e-5)


def silhouette(x, label):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = (label == label[i]).sum()
        others = [far[i, label == c].mean() for c in set(label.tolist()) - {label[i]}]
        if own == 1 or not others:
            out.append(0.0)
            continue
        a = far[i, label == label[i]].sum() / (own - 1)
        out.append((min(others) - a) / max(a, min(others)))
    return float(np.mean(out))


def test_silhouettes(spark, monkeypatch):
    monkeypatch.setattr(ward, "BLOCK", 50)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1, (70, 3)) for c in (0, 4, 8)])
    labels = np.stack([np.repeat([0, 1, 2], 70), np.arange(210) % 2, np.zeros(210, int), np.where(np.arange(210) == 9, 5, 1)], 1)
    df = spark.createDataFrame([(i, v.tolist(), *map(int, l)) for i, (v, l) in enumerate(zip(x, labels, strict=True))], "id long, v array<double>, p int, q int, r int, s int")
    got = {r.clustering: r.silhouette for r in ward.silhouettes(df, "id", "v", ["p", "q", "r", "s"]).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: pytest.approx(silhouette(x, labels[:, i]), abs=1e-8) for i, k in enumerate("pqrs")}


def test_kmeans_takes_the_best_silhouette(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    out, scores = vectors.kmeans(df, "vec_id", "embedding", (2, 3, 4))
    rows = out.orderBy("vec_id").collect()
    best = max(s for _, s in scores)
    assert silhouette(np.array([r.embedding for r in rows], float), np.array([r.cluster for r in rows])) == pytest.approx(best, abs=1e-9)


def plain_filter(x, least, most):
    keep = np.flatnonzero(x.var(0, ddof=1) > least)
    r = np.corrcoef(x[:, keep].T)
    return [int(d) for k, d in enumerate(keep) if not (np.abs(r[:k, k]) > most).any()]


@pytest.mark.parametrize(("rows", "columns", "block"), [(400, 37, 8), (900, 700, 512)])
def test_correlated_columns(spark, monkeypatch, rows, columns, block):
    monkeypatch.setattr(wide, "COLUMNS", block)
    monkeypatch.setattr(wide, "ROWS", 100)
    monkeypatch.setattr(wide, "CHUNKS", 2)
    rng = np.random.default_rng(columns)
    x = rng.normal(0, 1, (rows, columns)) + 1000
    for k in range(3, columns, 5):
        x[:, k] = x[:, k - 3] * (-2) + rng.normal(0, 0.01 if k % 2 else 3, rows)
    x[:, columns // 2] = 7.0
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    got = sorted(r.dim for r in wide.low_value_filter(df, "v", 1e-4, 0.95).collect())
    assert got == plain_filter(x, 1e-4, 0.95)


def test_five_thousand_columns(spark):
    """The product of all columns is 200 MB, a block's 2 MB."""
    rng = np.random.default_rng(8)
    base = rng.normal(0, 1, (64, 5000)).astype(np.float32)
    base[:, 4000] = base[:, 10]
    df = spark.createDataFrame([(r.tolist(),) for r in base], "v array<float>").repartition(2)
    pairs, dims = wide.correlated(df, "v", 0.999)
    assert [(r.a, r.b) for r in pairs.collect()] == [(10, 4000)] and dims.count() == 5000


def test_network_equals_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(3, 2, (300, 4))
    y = np.abs(x[:, 0] - 3) * x[:, 1] + rng.normal(0, 0.1, 300)
    fold = rng.integers(0, 3, 300)
    df = spark.createDataFrame([(i, v.tolist(), float(t), int(f)) for i, (v, t, f) in enumerate(zip(x, y, fold, strict=True))], "id long, x array<double>, y double, f int").repartition(4)
    got = {r.id: r.prediction for r in network.out_of_fold(df, "x", "y", "f", 3, hidden=6, rounds=12).collect()}
    for i in range(3):
        own, rest = fold == i, fold != i
        mean, spread = x[rest].mean(0), x[rest].std(0)
        m, s = y[rest].mean(), y[rest].std()
        a, b = (x[rest] - mean) / spread, (y[rest] - m) / s
        like = network.start(4, 6, 7 + i)
        line = np.concatenate([w.ravel() for w in like])
        adam = network.Adam(len(line), 0.03)
        for _ in range(12):
            line = adam.step(line, network.gradient(network.shaped(line, like), a, b)[:-1] / rest.sum())
        want = network.forward(network.shaped(line, like), (x[own] - mean) / spread)[2] * s + m
        assert np.allclose([got[j] for j in np.flatnonzero(own).tolist()], want, atol=1e-6)


def test_gradient_by_differences():
    rng = np.random.default_rng(7)
    w, x, y = network.start(3, 5, 1), rng.normal(0, 1, (20, 3)), rng.normal(0, 1, 20)
    line = np.concatenate([p.ravel() for p in w])
    loss = lambda v: 0.5 * ((network.forward(network.shaped(v, w), x)[2] - y) ** 2).sum()
    for i in range(0, len(line), 7):
        step = np.zeros(len(line))
        step[i] = 1e-6
        assert (loss(line + step) - loss(line - step)) / 2e-6 == pytest.approx(network.gradient(w, x, y)[i], abs=1e-4)


def test_network_learns_what_a_line_cannot(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (600, 2))
    y = np.abs(x[:, 0])
    df = spark.createDataFrame([(v.tolist(), float(t), i % 2) for i, (v, t) in enumerate(zip(x, y, strict=True))], "x array<double>, y double, f int")
    rows = network.out_of_fold(df, "x", "y", "f", 2, rounds=60).select(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    assert rows < 0.3 * y.var()


def test_equal_rows_are_one_point(spark):
    """Models are trained on a point for each fold and features, and a line is the one of all rows."""
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(10)
    x = rng.integers(0, 4, (900, 2)).astype(float)
    y = x[:, 0] * 2 + rng.normal(0, 40, 900)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double").withColumn("f", folds(F.col("id"), 2))
    points = network.points(df, "x", "y", "f")
    assert points.count() == 32 and points.agg(F.sum("n")).first()[0] == 900 and points.agg(F.sum(F.col("n") * F.col("q"))).first()[0] == pytest.approx((y * y).sum())
    got = models.out_of_fold(df.drop("f"), "id", "x", "y", 2, ("linear", "forest"))
    assert got.columns == ["id", "x", "y", "prediction", "model"] and got.count() == 1800
    held = vectors.as_ml(df, "x", "_f")
    want = {r.id: r.prediction for i in (0, 1) for r in LinearRegression(labelCol="y", featuresCol="_f", regParam=0.01).fit(held.where(F.col("f") != i)).transform(held.where(F.col("f") == i)).collect()}
    assert {r.id: r.prediction for r in got.where("model = 'linear'").collect()} == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}


def test_draws_have_their_means():
    keys = np.random.default_rng(11).integers(0, 1 << 64, 40_000, np.uint64)
    for mean in (1.0, 7.0, 64.0, 500.0):
        got = models.poisson(keys, np.full(len(keys), mean))
        assert got.mean() == pytest.approx(mean, rel=0.03) and got.var() == pytest.approx(mean, rel=0.05) and (got == models.poisson(keys, np.full(len(keys), mean))).all()
