"""Exact neighbours against all pairs, and how many pairs were compared."""

from __future__ import annotations

import difflib
import random

import numpy as np
from pyspark.sql import functions as F

from quarrymill.operators import nearest as N


def tanimoto(a, b):
    return round(len(a & b) / len(a | b), N.TANIMOTO_DECIMALS)


def all_sets(rows):
    held = [(i, set(s)) for i, s in rows if i is not None and s]
    out = {}
    for q, a in held:
        if q % 10 == 0:
            others = [(-tanimoto(a, b), i) for i, b in held if i != q]
            if others:
                t, i = min(others)
                out[q] = (i, -t)
    return out


def run_sets(spark, rows):
    df = spark.createDataFrame(rows, "id long, s array<string>").withColumn("query", F.lit("clash"))
    out = N.nearest_sets(df, "id", "s", F.col("id") % 10 == 0).collect()
    return {r.query: (r.id, r.tanimoto) for r in out}, sum(r.compared for r in out)


def test_sets_equal_all_pairs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        base = rng.randrange(60)
        rows.append((i, [f"m{base}-{k}" for k in range(12) if rng.random() < 0.8] + [f"c{rng.randrange(40)}" for _ in range(rng.randrange(4))] + ["everywhere"]))
    rows += [(1000, ["alone"]), (1010, ["alone too", "really"]), (1020, []), (1030, None), (None, ["x"]), (1040, rows[3][1]), (1041, rows[3][1] + rows[3][1]), (1050, rows[5][1])]
    got, compared = run_sets(spark, rows)
    assert got == all_sets(rows)
    assert compared < 60 * 600 / 4


def test_sets_of_one_hot_class(spark):
    rows = [(i, ["a", "b", "c"]) for i in range(3000)] + [(4000, ["a", "z"]), (4010, ["q"])]
    got, compared = run_sets(spark, rows)
    assert got[0] == (1, 1.0) and got[2990] == (0, 1.0) and got[4000] == (0, 0.25) and got[4010] == (0, 0.0) and compared <= 4


def test_few_sets(spark):
    assert run_sets(spark, [])[0] == {} and run_sets(spark, [(0, ["a"])])[0] == {}
    assert run_sets(spark, [(0, ["a"]), (1, ["b"])])[0] == {0: (1, 0.0)}


def all_vectors(rows):
    held = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, a in held:
        if q % 10 == 0:
            cos = [(-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), N.COSINE_DECIMALS), i) for i, b in held if i != q]
            if cos:
                c, i = min(cos)
                out[q] = (i, -c)
    return out


def run_vectors(spark, rows, **how):
    out = N.nearest_vectors(spark.createDataFrame(rows, "id long, v array<double>").withColumn("pivot", F.lit("clash")), "id", "v", F.col("id") % 10 == 0, **how).collect()
    return {r.query: (r.id, r.cosine) for r in out}, sum(r.compared for r in out)


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (40, 12))
    rows = [(i, (centres[i % 40] + rng.normal(0, 0.08, 12)).tolist()) for i in range(1200)]
    rows += [(2000, rows[7][1]), (2001, [3 * c for c in rows[7][1]]), (2010, [0.0] * 12), (2020, None), (2030, [float("nan")] * 12), (None, rows[0][1]), (2040, [-c for c in rows[9][1]])]
    got, compared = run_vectors(spark, rows, pivots=64)
    want = all_vectors(rows)
    assert set(got) == set(want)
    assert all(got[q][1] == want[q][1] for q in want) and sum(got[q][0] != want[q][0] for q in want) == 0
    assert compared < 120 * 1200 / 5


def test_vectors_without_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 24).tolist()) for i in range(300)]
    assert run_vectors(spark, rows)[0] == all_vectors(rows)


def test_few_vectors(spark):
    assert run_vectors(spark, [])[0] == {} and run_vectors(spark, [(0, [1.0])])[0] == {}
    assert run_vectors(spark, [(0, [1.0, 0.0]), (3, [1e-200, 0.0]), (1, [0.0, 2.0])])[0] == {0: (3, 1.0)}


def test_names_equal_all_pairs(spark):
    rng = random.Random(4)
    letters = "abcdefgh "
    names = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 24))) for _ in range(120)]
    for x in list(names[:60]):
        y = list(x)
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters), rng.choice(letters) * 2])
        names.append("".join(y))
    names += ["", "a", "aa", "aaaa aaaa aaaa", "aaaa aaaa", "É", "é"]
    asked = names[::3]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {(q, n) for q in set(asked) for n in set(names) if ratio(q, n) >= 0.75}
    df = N.similar_names(spark.createDataFrame([(n,) for n in [*names, None]], "x string"), "x", spark.createDataFrame([(n,) for n in [*asked, None]], "y string"), "y")
    got = {(r.query, r.name) for r in df.collect()}
    assert want <= got and len(got) < len(set(asked)) * len(set(names)) / 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
