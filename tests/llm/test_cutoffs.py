"""Certified cutoffs against the same tests done one by one with exact fractions."""

from __future__ import annotations

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from quarrymill.llm import quality


def tail(n, k, p):
    return float(sum(Fraction(math.comb(n, i)) * Fraction(p).limit_denominator(10**6) ** i * (1 - Fraction(p).limit_denominator(10**6)) ** (n - i) for i in range(k + 1)))


def test_cutoffs_and_verdicts(spark):
    rng = random.Random(91)
    rows, labels = [], []
    for i in range(5200):
        lang = "en" if i % 26 < 20 else ("de" if i % 26 < 25 else None)
        bad = rng.random() < 0.15
        n = rng.randint(50, 120)
        rows.append((i, lang, n, 5 * n, rng.randint(30, 90) if bad else int(rng.random() < 0.02), 0, 0, 10, rng.randint(0, 9), rng.randint(0, 3)))
        if i % 10 < 8:
            labels.append((i, 0 if bad else 1))
    columns = ("doc_id", "lang", *quality.COUNTS)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    half = {r.doc_id: r.h for r in docs.select("doc_id", (F.xxhash64("doc_id", F.lit("half")) % 2 == 0).alias("h")).collect()}
    rules = list(quality.scores())
    score = {r.doc_id: r for r in docs.select("doc_id", *(c.alias(k) for k, c in quality.scores().items())).collect()}
    good, strata = dict(labels), {r[0]: "null" if r[1] is None else f"={r[1]}" for r in rows}
    kinds, want = sorted(set(strata.values())), {}
    for s in kinds:
        for rule in rules:
            first = sorted(score[d][rule] for d in good if strata[d] == s and half[d])
            held = [score[d][rule] for d in good if strata[d] == s and not half[d] and good[d] == 1]
            want[s, rule] = None
            p = quality.RISK / len(rules)
            for level in quality.LEVELS:
                cut = first[max(0, math.ceil(level * len(first) - 1e-9) - 1)]
                k = sum(x > cut for x in held)
                if k >= len(held) * p or tail(len(held), k, p) > quality.ERROR / (len(kinds) * len(rules)):
                    break
                want[s, rule] = cut if want[s, rule] is None else min(cut, want[s, rule])
    got = {(r.stratum, r.rule): r.cutoff for r in quality.cutoffs(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got == want and any(v is not None for v in want.values()) and want["null", "symbols"] is None
    cuts = quality.cutoffs(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    for r in quality.judge(docs, cuts).collect():
        failed = [x for x in rules if want[strata[r.doc_id], x] is not None and score[r.doc_id][x] > want[strata[r.doc_id], x]]
        assert r.failed_rules == failed and r.kept == (not failed and not r.base_failed)
    assert columns[0] == "doc_id"
