"""Statistics against known numbers, and the operators' defined cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import numeric
from quarrymill.functions import text as X
from quarrymill.operators import graph, stats
from quarrymill.operators import relational as R
from quarrymill.streaming import runs


def test_tails():
    assert stats.chi2_tail(0.4464285714, 1) == pytest.approx(0.5040358665, abs=1e-9)
    assert stats.chi2_tail(0.7936507937, 1) == pytest.approx(0.3729984836, abs=1e-9)
    assert stats.fisher_greater(1, 1, 5, 19993) == pytest.approx(0.000599924996, abs=1e-9)
    assert stats.fisher_greater(0, 2, 6, 19992) == pytest.approx(1.0)
    assert stats.t_tail(0.0, 5) == pytest.approx(1.0)
    assert stats.f_tail(0.0, 2, 5) == pytest.approx(1.0)


def test_percentile_score(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 5)], "v double").select(numeric.percentile_score(F.col("v")).alias("s")).collect()
    assert sorted(r.s for r in rows) == [0, 0.375, 0.375, 0.75, 1]
    rows = spark.createDataFrame([(4.0,)] * 3, "v double").select(numeric.percentile_score(F.col("v")).alias("s")).collect()
    assert [r.s for r in rows] == [0.5] * 3


def test_kaplan_meier(spark):
    df = spark.createDataFrame([(2, 1), (3, 1), (3, 0), (5, 1), (8, 0)], "t int, e int")
    assert {r.time: round(r.survival, 9) for r in stats.kaplan_meier(df, "t", "e").collect()} == {2: 0.8, 3: 0.6, 5: 0.3}


def test_survival_by_ranges_and_groups(spark):
    rng = random.Random(12)
    rows = [(rng.randint(0, 120), int(rng.random() < 0.4), rng.choice(("a", "b", None))) for _ in range(700)]
    df = spark.createDataFrame(rows, "t int, e int, g string").repartition(3)

    def plain(rows):
        out, s = {}, 1.0
        for t in sorted({t for t, e, _ in rows if e}):
            n, d = sum(x >= t for x, *_ in rows), sum(x == t and e for x, e, _ in rows)
            s *= 1 - d / n
            out[t] = n, d, pytest.approx(s, abs=1e-9)
        return out

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert {r.time: (r.at_risk, r.events, r.survival) for r in stats.kaplan_meier(df, "t", "e").collect()} == plain(rows)
    got: dict = {}
    for r in stats.kaplan_meier(df, "t", "e", ["g"]).collect():
        got.setdefault(r.g, {})[r.time] = (r.at_risk, r.events, r.survival)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {g: plain([x for x in rows if x[2] == g]) for g in ("a", "b", None)}


def test_spearman(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 5.0), (5.0, 5.0)], "x double, y double")
    assert stats.spearman(df, "x", "y").first().rho == pytest.approx(0.8720815992723809)


def test_stable_id(spark):
    row = spark.createDataFrame([("RA", " Ruxolitinib ")], "a string, b string").select(X.stable_id("cand", F.col("a"), F.col("b")).alias("i")).first()
    assert row.i == "cand_92006a14e0751409"


def test_components(spark):
    nodes = spark.range(12).withColumnRenamed("id", "n")
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 10), (10, 11), (11, 9)], "u long, v long")
    got = {r.n: r.component for r in graph.components(nodes, "n", links).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 6, 7: 7, 8: 8, 9: 9, 10: 9, 11: 9}


def test_dictionary(spark):
    df = spark.createDataFrame([(x,) for x in "bca"], "v string").union(spark.createDataFrame([("a",)], "v string"))
    assert {r.v: r["index"] for r in graph.dictionary(df, "v").collect()} == {"a": 0, "b": 1, "c": 2}


def test_greedy_select(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "b", False), (4, "c", True), (5, "d", True)], "i int, k string, ok boolean")
    got = {r.i: r.action for r in R.greedy_select(df, [("i", False)], "k", 2, F.col("ok")).collect()}
    assert got == {1: "select", 2: "skip_duplicate", 3: "skip_missing", 4: "select", 5: "not_reached"}


def test_greedy_select_as_a_walk(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("abcdef"), rng.choice((True, False, None)), rng.choice((None, 1, 2, 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, k string, ok boolean, score int")
    for k in (1, 3, 5, 40):
        picked, want = set(), {}
        for i, key, ok, score in sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), r[0])):
            if len(picked) == k:
                want[i] = "not_reached"
            elif key in picked:
                want[i] = "skip_duplicate"
            elif not ok:
                want[i] = "skip_missing"
            else:
                want[i] = "select"
                picked.add(key)
        assert {r.i: r.action for r in R.greedy_select(df, [("score", True), ("i", False)], "k", k, F.col("ok")).collect()} == want


def test_ranks_by_ranges(spark):
    rng = random.Random(8)
    values = [rng.choice((rng.randint(0, 5), rng.random(), -0.0, 0.0, None)) for _ in range(400)]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, v double").repartition(4)
    held = [float(v) for v in values if v is not None]
    rank = lambda v: sum(x < v for x in held) + (sum(x == v for x in held) + 1) / 2
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (1, 3, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = {r.v: r.rank_v for r in stats.rank_table(df.where("v IS NOT NULL"), "v").collect()}
        assert got == {v: rank(v) for v in held}
        both = stats.ranked_values(df.withColumn("w", -F.col("v")).withColumn("u", F.lit(1)), ["v", "w", "u"], "least").collect()
        assert {(r.k, r.v): (r["rank"], r.n) for r in both} == {(k, x): (1 + sum(s * y < x for y in held), sum(s * y == x for y in held)) for k, s in ((0, 1), (1, -1)) for x in {s * v for v in held}} | {(2, 1.0): (1, len(values))}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {r.i: r.s for r in stats.percentile_scores(df, {"s": F.col("v")}).collect()}
    assert got == {i: None if v is None else (rank(float(v)) - 1) / (len(held) - 1) for i, v in enumerate(values)}
    assert stats.percentile_scores(df.where("false"), {"s": F.col("v")}).count() == 0
    assert {r.s for r in stats.percentile_scores(df.where("i < 9").withColumn("v", F.lit(2.0)), {"s": F.col("v")}).collect()} == {0.5}


def test_kendall_by_ranges(spark):
    rng = random.Random(9)
    rows = [(rng.choice((rng.randint(0, 6), rng.random())), rng.choice((rng.randint(0, 4), rng.random(), 2))) for _ in range(300)]
    sign = lambda v: (v > 0) - (v < 0)
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[:i]]
    s = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for a, b in pairs)
    free = [sum(a[k] != b[k] for a, b in pairs) for k in (0, 1)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rows] + [(None, 1.0), (1.0, None)], "x double, y double")
    for cells in (1, 7, 50, 1000):
        got = stats.kendall(df, "x", "y", cells).first()
        assert got.n == 300 and got.tau_b == pytest.approx(s / (free[0] * free[1]) ** 0.5, abs=1e-12)
    assert stats.kendall(df.where("false"), "x", "y").first().tau_b is None


def test_kendall_of_one_frequent_value(spark):
    rng = random.Random(10)
    rows = [(0.0, float(k)) for k in range(700)] + [(float(k), 3.0) for k in range(1, 400)] + [(rng.random(), rng.random()) for _ in range(200)]
    rng.shuffle(rows)
    sign = lambda v: (v > 0) - (v < 0)
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[:i]]
    s = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for a, b in pairs)
    free = [sum(a[k] != b[k] for a, b in pairs) for k in (0, 1)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(5)
    assert stats.kendall(df, "x", "y", 60).first().tau_b == pytest.approx(s / (free[0] * free[1]) ** 0.5, abs=1e-12)
    sizes = [r["count"] for r in stats.ranges(df.distinct(), 20, "a", "x", "y").groupBy("a").count().collect()]
    assert max(sizes) <= 130 and len(sizes) >= 18  # 1,299 cells, of which 700 have one x


def test_contains_join(spark):
    a = ["", "a", "ab", "abc", "abcd", "xabcdx", "b c"]
    df = spark.createDataFrame([(x,) for x in a], "t string")
    got = {(r.t, r.p) for r in R.contains_join(df, "t", df.select(F.col("t").alias("p")), "p").collect()}
    assert got == {(x, y) for x in a for y in a if y and y in x}


def test_stream(spark, tmp_path):
    source = tmp_path / "events"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(source))
    events = runs.event_stream(spark, str(source))
    runs.write(runs.run_states(events), "states", str(tmp_path / "c1"), "complete").awaitTermination()
    want = spark.read.parquet(str(source)).select("user_id").distinct().count()
    assert spark.table("states").count() == want
    runs.write(runs.windowed_counts(events), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
