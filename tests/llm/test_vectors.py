"""Vector codes against plain integer rounds, whitening against exact fractions."""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import codes, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASH = ("id", "x", "code", "codes", "lower", "n", "component", "error", "_label")


def made(n, width, seed, *, near=False):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.15, (n, width)).astype(np.float32)
    if near:  # few values, so many ties and equal parts
        v = (rng.integers(-2, 3, (n, width)) / 1024).astype(np.float32)
    ids = rng.permutation(10 * n)[:n]
    return [(int(i), [float(c) for c in row], int(k) if k < 5 else None) for i, row, k in zip(ids, v, rng.integers(0, 6, n), strict=True)]


ODD = [(3_000_000, None, 1), (3_000_001, [], 1), (3_000_002, [None] * 8, 1), (3_000_003, [float("nan")] + [0.0] * 7, 1), (3_000_004, [float("inf")] + [0.0] * 7, None), (3_000_005, [0.5] * 5, 2)]


def kept(rows, width):
    good = [r for r in rows if r[1] and len(r[1]) == width and all(c is not None and np.isfinite(c) for c in r[1])]
    return sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def plain_codes(rows, width, parts=4, entries=256, rounds=4):
    rows = kept(rows, width)
    x = np.array([[int(np.floor(np.float64(c) * 1024)) for c in r[1]] for r in rows], np.int64)
    cut = [x[:, p * width // parts : (p + 1) * width // parts] for p in range(parts)]
    books = [c[:entries].copy() for c in cut]
    near = lambda c, b: ((c[:, None] - b[None]) ** 2).sum(2)
    for _ in range(rounds):
        for c, b in zip(cut, books, strict=True):
            code = near(c, b).argmin(1)
            for j in set(code.tolist()):
                b[j] = c[code == j].sum(0) // int((code == j).sum())
    d = [near(c, b) for c, b in zip(cut, books, strict=True)]
    code = np.stack([m.argmin(1) for m in d], 1)
    error = sum(m.min(1) for m in d)
    total = {}
    for r, e in zip(rows, error.tolist(), strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    return sorted((str(r[0]), bytes(c.astype(np.uint8)).hex(), e, total[r[2]], sha) for r, c, e in zip(rows, code, error.tolist(), strict=True))


def run_codes(spark, rows, **how):
    out = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in CLASH}), **how)
    assert dict(out.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in out.collect())


@pytest.mark.parametrize("n,near", [(700, False), (900, True), (40, False), (1, False)])
def test_codes_equal_plain_rounds(spark, n, near):
    rows = made(n, 8, n, near=near) + ODD
    rows += [(rows[0][0], rows[0][1], rows[0][2]), (None, rows[0][1], 3), (2_900_000, [-c for c in rows[0][1]], 9)]
    assert run_codes(spark, rows) == plain_codes(rows, 8)


def test_codes_of_few_entries_and_many_rounds(spark):
    rows = made(500, 8, 77)
    assert run_codes(spark, rows, parts=2, entries=7, rounds=9) == plain_codes(rows, 8, 2, 7, 9)


def test_codes_of_large_components(spark):
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(np.random.default_rng(1).normal(0, 25_000, (300, 4)))]
    assert run_codes(spark, [(i, r, 0) for i, r in rows], entries=16) == plain_codes([(i, list(np.float32(r).tolist()), 0) for i, r in rows], 4, entries=16)


def test_codes_of_nothing(spark):
    assert run_codes(spark, []) == [] and run_codes(spark, ODD[:5]) == []


def test_bounds_prune_and_never_exclude_the_nearest():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-60, 60, (64, 6)) + 400 * k for k in range(8)])
    rows = x[rng.permutation(len(x))[:48]]
    before = codes.Entries(rows, None)
    code, upper, lower = before.first(x)
    looked = 0
    for _ in range(6):
        moved = np.stack([x[code == j].sum(0) // max(1, (code == j).sum()) if (code == j).any() else before.rows[j] for j in range(len(rows))])
        now = codes.Entries(moved, before.rows)
        code, upper, lower, n = now.again(x, code, upper, lower)
        d = ((x[:, None] - moved[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all()
        assert (lower <= np.sqrt(d) + 1e-9).all() and (upper >= np.sqrt(d.min(1)) - 1e-9).all()
        looked, before = looked + n, now
    assert looked < 6 * len(x) * len(rows) / 4


def test_codes_are_decoded(spark):
    rows = made(300, 8, 5)
    coded, books = codes.fit(spark.createDataFrame(rows, SCHEMA), entries=16)
    whole = {r[0]: [int(np.floor(np.float64(c) * 1024)) for c in r[1]] for r in rows}
    for r in codes.decoded(coded, books).collect():
        assert sum((a - b) ** 2 for a, b in zip(whole[r.id], r.x, strict=True)) == r.error


def exact(rows, width):
    """n, sums, exact covariance in fractions, and each row's vector and deviation."""
    rows = kept(rows, width)
    x = [[int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in r[1]] for r in rows]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    v = [[Fraction(sum((n * f[i] - sums[i]) * (n * f[j] - sums[j]) for f in fit), n**3) for j in range(width)] for i in range(width)]
    return rows, x, n, sums, np.array([[float(c) for c in r] for r in v])


def run_whitened(spark, rows, parts=3):
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({c: F.lit("clash") for c in CLASH}))
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    return out.collect()


@pytest.mark.parametrize("n,width", [(400, 8), (300, 20), (12, 6)])
def test_whitening_equals_fractions(spark, n, width):
    rows = made(n, width, n) + ([r for r in ODD if width == 8] if width == 8 else [])
    rows += [(8_000_000 + i, rows[3][1], 0) for i in range(25)]  # one hot vector counts once
    held, x, n, sums, v = exact(rows, width)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(16, width, n - 1)
    got: dict = {}
    for r in run_whitened(spark, rows, 70):
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == sorted({r[0] for r in held})
    sign = None
    for row, xs in zip(held, x, strict=True):
        mine = got[row[0]]
        assert sorted(mine) == list(range(1, k + 1))
        want = np.array([float(Fraction(a * n - s, n)) for a, s in zip(xs, sums, strict=True)]) @ vectors[:, :k] / np.sqrt(values[:k])
        have = np.array([mine[c].whitened for c in range(1, k + 1)])
        if sign is None:
            sign = np.sign(want * have)
        assert np.allclose(have * sign, want, atol=1e-8)
        for c, r in mine.items():
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(xs, sums, strict=True))
            assert r.explained == pytest.approx(values[c - 1] / v.trace(), rel=1e-9) and r.identity_error < 1e-9


def test_products_are_exact_where_doubles_are_not():
    rng = np.random.default_rng(9)
    high = rng.normal(0, 1, (500, 5)) * 2.0 ** rng.integers(-20, 20, (500, 5))
    low = high * 2.0**-54 * rng.normal(0, 1, (500, 5))
    got = whitening.gram(high, low)
    for i in range(5):
        for j in range(5):
            want = sum((Fraction(a) + Fraction(b)) * (Fraction(c) + Fraction(d)) for a, b, c, d in zip(high[:, i].tolist(), low[:, i].tolist(), high[:, j].tolist(), low[:, j].tolist(), strict=True))
            assert abs(Fraction(float(got[0][i, j])) + Fraction(float(got[1][i, j])) - want) <= Fraction(500 * float(np.abs(high).max()) ** 2) / 2**60


def test_whitening_of_nothing_and_of_one(spark):
    assert run_whitened(spark, []) == [] and run_whitened(spark, ODD[:5]) == []
    assert run_whitened(spark, [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)]) == []


def test_deviation_beyond_64_bits_is_null(spark):
    rows = [(i, [1e9 * i, -1e9 * i], 0) for i in range(5)]
    out = run_whitened(spark, rows)
    assert {r.deviation for r in out} == {None, 0} or {r.deviation for r in out} == {None}


def test_queries(spark):
    for name, least in (("op12_vector_codes", 500), ("op13_whitening", 8000)):
        assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() == least
