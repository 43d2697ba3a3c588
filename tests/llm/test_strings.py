"""Removal of repeated strings on texts that are built against hashes and blocks, by brute force."""

from __future__ import annotations

import collections
import random

import pytest
from test_operators import prose

from quarrymill.llm import substrings


def brute(held, length=400):
    count = collections.Counter(b[i : i + length] for _, b in held for i in range(len(b) - length + 1))
    want = collections.Counter()
    for d, b in held:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        want[d, len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    return want


def found(spark, rows):
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    return collections.Counter((r.doc_id, r.n_bytes, sum(x.end - x.first for x in r.removed), bytes(r.kept)) for r in got)


def test_strings_that_collide_in_polynomials(spark):
    one = "".join("u" if i.bit_count() % 2 == 0 else "K" for i in range(256))
    two = one.translate({117: "K", 75: "u"})
    rng = random.Random(51)
    gap = "".join(rng.choice("abcdefghij klmnopqrst") for _ in range(256))
    rows = [(1, one + gap + two + "." * 26), (2, two + gap + one + "." * 26)]
    assert found(spark, rows) == brute([(d, t.encode()) for d, t in rows])


@pytest.mark.parametrize("hot", [1000, 3, 0])
def test_a_passage_in_many_texts(spark, monkeypatch, hot):
    rng = random.Random(52)
    passage, other = prose(rng, 70), prose(rng, 64)
    rows = [(i, prose(rng, rng.randint(0, 30)) + passage[rng.randint(0, 9) : len(passage) - rng.randint(0, 9)] + prose(rng, rng.randint(0, 30))) for i in range(60)]
    rows += [(100 + i, prose(rng, 10) + other[: 380 + 5 * i] + prose(rng, 10)) for i in range(12)]
    rows += [(200, passage + passage), (201, "ab" * 600), (None, passage), (202, None), (203, "x" * 399)]
    monkeypatch.setattr(substrings, "HOT", hot)
    assert found(spark, rows) == brute([(d, (t or "").encode()) for d, t in rows])
