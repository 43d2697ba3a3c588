"""Queries over whole tables, held against brute force and their SQL."""

from __future__ import annotations

import difflib

import duckdb
import pyarrow.parquet as pq
import pytest
from test_queries import plain

from quarrymill.plans import registry

FOLDER = "/root/testdata/sf0.01"
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def parts():
    return pq.read_table(f"{FOLDER}/part.parquet").to_pylist()


def test_components(spark, parts):
    root = {p["p_partkey"]: p["p_partkey"] for p in parts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = {}
    for p in parts:
        for key in (("price", p["p_retailprice"]), *([("brand", p["p_brand"], p["p_size"])] if p["p_size"] < 8 else [])):
            a, b = find(p["p_partkey"]), find(seen.setdefault(key, p["p_partkey"]))
            root[max(a, b)] = min(a, b)
    want = {k: find(k) for k in root}
    assert len(want) > 400
    assert {r.p_partkey: r.component for r in QUERIES["er01_components"](spark, FOLDER).collect()} == want
    best, n = {}, {}
    for p in parts:
        c = want[p["p_partkey"]]
        n[c] = n.get(c, 0) + 1
        best[c] = min(best.get(c, (2,)), (0 if p["p_size"] > 20 else 1, len(p["p_name"]), p["p_name"], p["p_partkey"]))
    assert {(r.component, r.name, r.n) for r in QUERIES["er02_representative"](spark, FOLDER).collect()} == {(c, best[c][2], n[c]) for c in n}


def rows_of(spark, name):
    df = QUERIES[name](spark, FOLDER)
    return sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", ["ds08_set_links", "ds29_rerank", "jn06_anti_or", "jn14_substring", "jn15_synonyms", "jn20_either_key", "vl09_seed_checks"])
def test_whole_tables(spark, name):
    con = duckdb.connect()
    for n in ("part", "region", "lineitem", "supplier", "customer"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{FOLDER}/{n}.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert rows_of(spark, name) == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())


def test_grades_reach_all_parts(spark, parts):
    assert {r.p_partkey for r in QUERIES["ds08_fisher_grades"](spark, FOLDER).select("p_partkey").collect()} == {p["p_partkey"] for p in parts}


def test_fuzzy(spark, parts):
    names, sought = {p["p_name"].lower() for p in parts}, {p["p_name"].lower() for p in parts if p["p_partkey"] % 100 == 0}
    ratio = lambda q, n: difflib.SequenceMatcher(None, q, n).ratio()
    want = {(q, n, r) for q in sought for n in names if 4 * abs(len(q) - len(n)) <= len(q) + len(n) and 0.75 <= (r := ratio(q, n)) < 1}
    assert len(sought) > 8 and {(r["query"], r["name"], r["ratio"]) for r in QUERIES["jn19_fuzzy"](spark, FOLDER).collect()} == want
