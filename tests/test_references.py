"""Queries that SQL cannot express against plain Python and numpy, over whole tables."""

from __future__ import annotations

import math
import os
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from quarrymill.operators import stats
from quarrymill.plans import registry
from quarrymill.sources import tables as T

FOLDER = "/root/testdata/sf0.01"
QUERIES = registry.queries()


def table(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def matrix():
    rows = sorted(table("embeddings"), key=lambda r: r["vec_id"])
    return np.array([r["embedding"] for r in rows], float), np.array([r["label"] for r in rows])


def test_log_rank(spark):
    first, last = {}, {}
    for r in table("events"):
        u, e = r["user_id"], r["event_id"]
        last[u] = max(last.get(u, e), e)
        if r["event_type"] == "purchase":
            first[u] = min(first.get(u, e), e)
    rows = [(math.floor(first.get(u, last[u]) / 500), int(u in first), u % 3) for u in last]
    z, v = np.zeros(3), np.zeros((3, 3))
    for t in sorted({t for t, e, _ in rows if e}):
        risk = np.array([sum(x >= t and g == k for x, _, g in rows) for k in range(3)], float)
        died = np.array([sum(x == t and e and g == k for x, e, g in rows) for k in range(3)], float)
        n, d = risk.sum(), died.sum()
        if n > 1:
            z += died - d * risk / n
            v += d * (n - d) / (n - 1) * (np.diag(risk / n) - np.outer(risk, risk) / n**2)
    want = z[:2] @ np.linalg.solve(v[:2, :2], z[:2])
    got = QUERIES["ds16_log_rank"](spark, FOLDER).first()
    assert (got.statistic, got.dof) == (pytest.approx(want, abs=1e-5), 2) and got.p == pytest.approx(stats.chi2_tail(want, 2), abs=1e-5)


def upper_tail(a, b, c, d):
    r, s, n = a + b, a + c, a + b + c + d
    return float(sum(Fraction(math.comb(r, k) * math.comb(n - r, s - k), math.comb(n, s)) for k in range(a, min(r, s) + 1)))


def test_fisher(spark):
    x = Counter((p["p_size"] > 45, p["p_retailprice"] > 1900) for p in table("part"))
    cells = x[True, True], x[True, False], x[False, True], x[False, False]
    got = QUERIES["ds19_fisher"](spark, FOLDER).first()
    assert (got.a, got.b, got.c, got.d) == cells and got.p == pytest.approx(upper_tail(*cells), abs=1e-8)


def test_pca(spark, matrix):
    x, _ = matrix
    scaled = (x - x.mean(0)) / x.std(0)
    _, _, axes = np.linalg.svd(scaled, full_matrices=False)
    want = np.abs(scaled @ axes[:2].T)
    got = {r.vec_id: (r.pca1, r.pca2) for r in QUERIES["ds20_pca"](spark, FOLDER).collect()}
    assert np.allclose([got[k] for k in sorted(got)], want, atol=1e-4)


def test_cluster_scores(spark, matrix):
    x, label = matrix
    names = sorted(set(label))
    means = np.array([x[label == k].mean(0) for k in names])
    inner = sum(((x[label == k] - m) ** 2).sum() for k, m in zip(names, means, strict=True))
    outer = sum((label == k).sum() * ((m - x.mean(0)) ** 2).sum() for k, m in zip(names, means, strict=True))
    wide = [np.linalg.norm(x[label == k] - m, axis=1).mean() for k, m in zip(names, means, strict=True)]
    db = np.mean([max((wide[i] + wide[j]) / np.linalg.norm(means[i] - means[j]) for j in range(len(names)) if i != j) for i in range(len(names))])
    got = QUERIES["ds22_cluster_scores"](spark, FOLDER).first()
    ch = outer / (len(names) - 1) / (inner / (len(x) - len(names)))
    assert got.k == len(names) and got.calinski_harabasz == pytest.approx(ch, rel=1e-4) and got.davies_bouldin == pytest.approx(db, rel=1e-4)


def test_ward(spark, matrix):
    """Every merge, in the order of heights, costs the growth of the squares within clusters that its height says, and towards the end no other pair costs less."""
    x, _ = matrix
    groups = {i: [i] for i in range(len(x))}
    spread = lambda rows: float(((x[rows] - x[rows].mean(0)) ** 2).sum())
    merges = sorted(QUERIES["ds22_ward"](spark, FOLDER).collect(), key=lambda r: r.height)
    assert len(merges) == len(x) - 1
    for k, r in enumerate(merges):
        a, b = groups.pop(r.a), groups.pop(r.b)
        assert min(a) == r.a < r.b == min(b)
        assert r.height == pytest.approx(math.sqrt(2 * (spread(a + b) - spread(a) - spread(b))), abs=2e-5)
        if k > len(x) - 40:
            least = min(spread(p + q) - spread(p) - spread(q) for i, p in groups.items() for j, q in groups.items() if i < j) if len(groups) > 1 else math.inf
            assert r.height**2 / 2 <= least + 1e-4
        groups[r.a] = a + b


def test_feature_filter(spark, matrix):
    x, _ = matrix
    keep = [i for i in range(x.shape[1]) if x[:, i].var(ddof=1) > 1e-4]
    m, out = np.corrcoef(x[:, keep].T), []
    for a in range(len(keep)):
        if not any(abs(m[b, a]) > 0.95 for b in range(a)):
            out.append(keep[a])
    assert sorted(r.dim for r in QUERIES["ds23_feature_filter"](spark, FOLDER).collect()) == out


def test_kmeans(spark, matrix):
    x, _ = matrix
    rows = QUERIES["ds21_kmeans"](spark, FOLDER).collect()
    assert sum(r.n for r in rows) == len(x) and len(rows) == rows[0].k and sum(r.share for r in rows) == pytest.approx(1, abs=1e-4)
    assert {r.imbalance for r in rows} == {round(max(r.n for r in rows) / min(r.n for r in rows), 2)} and -1 <= rows[0].silhouette <= 1


def test_fisher_grades(spark):
    words, brands = defaultdict(set), defaultdict(set)
    for p in table("part"):
        words[p["p_partkey"]] |= set(p["p_name"].split(" "))
        brands[p["p_brand"]] |= set(p["p_name"].split(" "))
    got = QUERIES["ds08_fisher_grades"](spark, FOLDER).collect()
    for r in got[:: max(1, len(got) // 200)]:
        shared = len(words[r.p_partkey] & brands[r.p_brand])
        assert shared > 0


def test_listing(spark):
    got = {(r.name, r.length) for r in QUERIES["src24_listing"](spark, FOLDER).collect()}
    assert got == {(n, os.path.getsize(f"{FOLDER}/{n}")) for n in os.listdir(FOLDER) if n.endswith(".parquet")}


def test_out_of_fold(spark):
    rows = {r.model: r for r in QUERIES["ds26_out_of_fold"](spark, FOLDER).collect()}
    price = np.array([r["l_extendedprice"] for r in table("lineitem")])
    assert set(rows) == {"linear", "forest", "boosted", "network"}
    assert all(r.n == len(price) and 0 < r.rmse <= 1.01 * price.std() for r in rows.values())
    plain = {r.model: r for r in QUERIES["ds26_plain_folds"](spark, FOLDER).collect()}
    assert set(plain) == {"linear", "network"} and all(r.n == len(price) and 0 < r.rmse <= 1.01 * price.std() for r in plain.values())


def test_triples(spark):
    rows = QUERIES["ds30_embedding_scores"](spark, FOLDER).collect()
    tails = defaultdict(list)
    for r in rows:
        assert r.score == pytest.approx((r.distmult + r.transe) / 2, abs=1e-5)
        tails[r.tail].append((r.distmult, r.transe))
    assert all(min(x) == (0, 0)[k] and max(x) == 1 for v in tails.values() if len(v) > 1 for k, x in enumerate(zip(*v, strict=True)))


def test_jdbc(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    nations = spark.read.parquet(f"{FOLDER}/nation.parquet")
    for name, df in (("nation", nations), ("region", spark.read.parquet(f"{FOLDER}/region.parquet"))):
        df.write.format("jdbc").options(url=f"{url};create=true", dbtable=name, driver=driver).save()
    got = T.read_jdbc(spark, url, 'SELECT n."n_name", r."r_name" FROM nation n LEFT JOIN region r ON r."r_regionkey" = n."n_regionkey"', driver)
    split = T.read_jdbc(spark, url, 'SELECT "n_nationkey", "n_name" FROM nation', driver, partitionColumn='"n_nationkey"', lowerBound="0", upperBound="25", numPartitions="3")
    assert split.rdd.getNumPartitions() == 3 and split.count() == 25
    ranges = T.read_jdbc_ranges(spark, url, 'SELECT "n_nationkey" * "n_nationkey" AS "k", "n_name" FROM nation', '"k"', 4, driver)
    assert sorted(r.k for r in ranges.collect()) == sorted(r["n_nationkey"] ** 2 for r in table("nation"))
    assert ranges.rdd.getNumPartitions() == 4 and max(ranges.rdd.glom().map(len).collect()) <= 7
    odd = spark.createDataFrame([("", 1), ("a", 2), ("a'b", 3), ("c", 4), ("c", 5)], "k string, v int")
    odd.write.format("jdbc").options(url=url, dbtable="odd", driver=driver, createTableColumnTypes="k VARCHAR(9)").save()
    assert sorted(r.v for r in T.read_jdbc_ranges(spark, url, 'SELECT "k", "v" FROM odd', '"k"', 2, driver).collect()) == [1, 2, 3, 4, 5]
    assert T.read_jdbc_ranges(spark, url, 'SELECT "k", "v" FROM odd WHERE "v" > 9', '"k"', 2, driver).count() == 0
    names = {r["r_regionkey"]: r["r_name"] for r in table("region")}
    assert {(r.n_name, r.r_name) for r in got.collect()} == {(r["n_name"], names[r["n_regionkey"]]) for r in table("nation")}
