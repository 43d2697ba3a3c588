"""The mix of sources against plain Python: sizes, targets, budgets, and the knapsack against all sums."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import prose

from quarrymill.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string"


def expected_targets(sizes: dict, weights=mixing.WEIGHTS, most=3) -> dict:
    """Shares by weight, cut and shared out again one turn at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        rest = total - sum(stopped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return stopped | share
        stopped |= {s: most * sizes[s] for s in above}


def size(text) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def run(spark, rows):
    return [r.asDict() for r in mixing.mix(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("size", "n", "target", "copies", "_r", "more")})).collect()]


def held(rng, sources):
    return [(i, prose(rng, max(1, int(rng.paretovariate(1.1) * 9)) % 4000), s) for i, s in enumerate(rng.choices(*zip(*sources.items(), strict=True), k=400))]


@pytest.mark.parametrize("sources", [{"a": 9, "b": 3, "c": 1, "d": 1}, {"z": 20, None: 3, "": 2, "é": 1, "Z": 1}, {"only": 1}])
def test_targets_and_budgets(spark, sources):
    rows = held(random.Random(len(sources)), sources)
    rows += [(None, "no id at all", "z"), (7, rows[7][1], rows[7][2]), (900, None, "hollow"), (901, " \n", "hollow"), (902, "", None)]
    out, sizes = run(spark, rows), {}
    for _, text, s in rows:
        sizes[s] = sizes.get(s, 0) + size(text)
    goals = expected_targets(sizes)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in out) == sorted((d or -1, size(t)) for d, t, _ in rows)
    taken = {}
    of = {}
    for r in out:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] = taken.get((r["source_size"], round(r["target"], 6)), 0) + r["taken"]
    for s, goal in goals.items():
        of.setdefault((sizes[s], round(goal, 6)), []).append(goal)
    assert sorted(of) == sorted(taken)
    for key, goals_ in of.items():
        assert abs(taken[key] - sum(goals_)) <= len(goals_) * 1.0, key  # many sizes, so each sum is met but for rounding
    assert sorted(map(str, run(spark, rows))) == sorted(map(str, out))


def test_a_source_stops_at_three_times_its_size(spark):
    rows = [(i, prose(random.Random(i), 40), "a") for i in range(3)] + [(10 + i, prose(random.Random(i), 50), "b") for i in range(200)]
    out = run(spark, rows)
    assert {r["taken"] for r in out if r["source_size"] == 120} == {120} and {r["target"] for r in out if r["source_size"] == 120} == {360.0}
    assert sum(r["taken"] for r in out if r["source_size"] != 120) == pytest.approx(10_120 - 360, abs=25)


def test_crowded_sizes_are_ranked_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    rows = [(i, "one two three four five", s) for i, s in enumerate(["a"] * 700 + ["b"] * 500 + ["c"] * 300)]
    out = run(spark, rows)
    for n, words in ((3500, 4687.5), (2500, 1875.0), (1500, 937.5)):
        assert abs(sum(r["taken"] for r in out if r["source_size"] == n) - words) <= 2.5


def test_knapsack_finds_the_nearest_sum():
    rng = random.Random(3)
    for _ in range(150):
        sizes = np.array(sorted(rng.sample(range(0, 40), rng.randint(1, 5))))
        counts = np.array([rng.randint(0, 3) for _ in sizes])
        budget = rng.randint(0, 150)
        sums = {sum(int(s) * k for s, k in zip(sizes, ks, strict=True)) for ks in itertools.product(*(range(c + 1) for c in counts))}
        taken = mixing.knapsack(sizes, counts, budget)
        assert (taken <= counts).all() and (taken >= 0).all()
        got = int((taken * sizes).sum())
        assert abs(got - budget) == min(abs(s - budget) for s in sums), (sizes, counts, budget)


def test_large_budgets_leave_a_window_to_the_knapsack():
    rng = np.random.default_rng(5)
    sizes = np.unique(rng.integers(1, 20_000, 3000))
    counts = rng.integers(1, 500, len(sizes))
    total = int((sizes * counts).sum())
    for budget in (total // 3, total - 1, total, 2 * total + 12_345, 3 * total):
        whole, more = mixing.fitted(sizes, counts, budget)
        assert (more <= counts).all() and abs(whole * total + int((more * sizes).sum()) - budget) <= 1


def test_empty_table_and_texts(spark):
    assert run(spark, []) == []
    out = run(spark, [(1, None, "a"), (2, "", None)])
    assert [(r["size"], r["target"], r["taken"]) for r in out] == [(0, 0.0, 0)] * 2


def test_the_mix_itself_repeats_documents(spark):
    rows = [(1, "a b c", "x"), (2, "d e", "y"), (3, "f", "z"), (4, "g h i j k l m n", "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    got = [r.doc_id for r in mixing.mixed(docs).collect()]
    assert {d: got.count(d) for d in want} == want


def test_query(spark):
    out = queries.queries()["op11_mixing"](spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    sums = out.groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.countDistinct("doc_id")).collect()
    assert all(abs(r.t - r.target) <= 0.02 * r.target for r in sums if r.source_size > 1000)
