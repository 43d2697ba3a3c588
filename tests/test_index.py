"""Search in a kept index against a scan for each query."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import search as S

FIELDS = {"title": 3.0, "body": 1.0}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    pick = lambda n: " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(300)], k=n))
    rows = [(i, pick(rng.randint(1, 6)), pick(rng.randint(0, 60)) + (" zebra w1" if i % 97 == 0 else "")) for i in range(900)]
    rows += [(2000, None, "zebra w1 w1"), (2001, "", ""), (2002, "the of", None), (2003, "Zebra, W1!", None)]
    return spark.createDataFrame(rows, "key long, title string, body string")


@pytest.fixture(scope="module")
def index(docs):
    return S.build(docs, "key", FIELDS, buckets=8)


QUERIES = [(1, "w1 zebra"), (2, "w3"), (3, "w0 w1 w2"), (4, "w250 w0"), (5, "unheard w1"), (6, "the"), (7, ""), (8, "W5, w5 w9!"), (9, "zebra"), (10, None), (11, "w299")]


def scanned(docs, text, k):
    hits = S.search(docs, "key", FIELDS, text or "").select("key", F.round("score", S.DECIMALS).alias("score")).collect()
    return [(r.key, r.score) for r in sorted(hits, key=lambda r: (-r.score, r.key))[:k]]


@pytest.mark.parametrize("first", [1, 8])
def test_same_as_a_scan(spark, docs, index, monkeypatch, first):
    monkeypatch.setattr(S, "FIRST_BLOCKS", first)
    monkeypatch.setattr(S, "BLOCK", S.BLOCK)
    asked = spark.createDataFrame(QUERIES, "query_id long, q string").withColumn("key", F.lit("clash"))
    got: dict = {}
    for r in S.top(index, asked, "query_id", "q", 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.key, r.score))
    for q, text in QUERIES:
        assert [x[1:] for x in sorted(got.get(q, []))] == scanned(docs, text, 7), text


def test_small_blocks_give_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    monkeypatch.setattr(S, "FIRST_BLOCKS", 2)
    small = S.build(docs, "key", FIELDS, buckets=2)
    asked = spark.createDataFrame(QUERIES, "query_id long, q string")
    got: dict = {}
    for r in S.top(small, asked, "query_id", "q", 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.key, r.score))
    for q, text in QUERIES:
        assert [x[1:] for x in sorted(got.get(q, []))] == scanned(docs, text, 3), text


def test_restricted_to_some_keys(spark, docs, index):
    asked = spark.createDataFrame([(1, "w1 zebra"), (2, "w2")], "query_id long, q string")
    among = docs.where("key % 2 = 0").select("key")
    for r in S.top(index, asked, "query_id", "q", 5, among).collect():
        assert r.key % 2 == 0
        want = dict(scanned(docs, "w1 zebra" if r.query_id == 1 else "w2", 10_000))
        assert r.score == pytest.approx(want[r.key])


def test_only_the_sought_buckets_are_read(spark, index):
    asked = spark.createDataFrame([(1, "w17 w4")], "query_id long, q string")
    sought = S._sought(index, asked, "query_id", "q")
    plan = sought._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    assert {r.bucket for r in sought.collect()} == set(S._buckets(sought)) and len(S._buckets(sought)) <= 2


def test_blocks_stay_small_and_bound_their_postings(spark, index):
    blocks = index.blocks(spark)
    assert blocks.where("bound < array_max(transform(docs, x -> x.weight))").count() == 0
    assert blocks.select(F.max(F.size("docs"))).first()[0] <= 4 * S.BLOCK
    assert blocks.groupBy("field", "term").agg(F.sum(F.size("docs")).alias("n")).join(index.terms(spark), ["field", "term"]).where("n <> df").count() == 0
