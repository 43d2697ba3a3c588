"""Benchmark items in long texts, items that many documents hold, several blocks of items, and all windows by brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_leaks import found
from test_operators import prose

from quarrymill.llm import decontaminate as D


def corpus(n, words, kind, seed):
    """Documents of so many words each, by Zipf's law or all alike."""
    rng = np.random.default_rng(seed)
    known = 50_000
    p = 1 / np.arange(1, known + 1) if kind == "zipf" else np.ones(known)
    return [[f"w{k}" for k in row] for row in rng.choice(known, (n, words), p=p / p.sum())]


@pytest.mark.parametrize(("kind", "words", "n"), [("zipf", 1000, 60), ("zipf", 6000, 40), ("zipf", 12_000, 30), ("uniform", 300, 60), ("uniform", 1500, 60)])
def test_copies_in_long_texts(spark, kind, words, n):
    docs = corpus(n, words, kind, words)
    item = corpus(1, 40, kind, 7)[0]
    for d in range(5):
        docs[d][words // 2 : words // 2] = item
    assert found(spark, [(i, " ".join(t)) for i, t in enumerate(docs)], [(1, " ".join(item))]) == {(d, 1) for d in range(5)}


@pytest.mark.parametrize(("words", "holders", "n"), [(300, 20, 200), (3000, 20, 60), (80, 60, 60)])
def test_items_that_many_documents_hold(spark, words, holders, n):
    docs = corpus(n, words, "zipf", words)
    item = corpus(1, 40, "zipf", 8)[0]
    for d in range(holders):
        docs[d][words // 3 : words // 3] = item
    assert found(spark, [(i, " ".join(t)) for i, t in enumerate(docs)], [(1, " ".join(item))]) == {(d, 1) for d in range(holders)}


def test_items_of_everyday_words(spark):
    """A table of few words: nothing has a weight, so words alone decide."""
    rng = random.Random(3)
    few = [f"e{k}" for k in range(12)]
    docs = [[rng.choice(few) for _ in range(150)] for _ in range(40)]
    item = [rng.choice(few) for _ in range(60)]
    docs[4][50:50] = item
    docs[9][20:20] = [w if k % 5 else "other" for k, w in enumerate(item)]
    assert {(4, 1), (9, 1)} <= found(spark, [(i, " ".join(t)) for i, t in enumerate(docs)], [(1, " ".join(item))])


def test_paraphrases_in_long_texts(spark):
    rng = random.Random(35)
    docs = corpus(24, 12_000, "zipf", 9)
    items, want = [], set()
    for i in range(96):
        words = [f"w{int(50_000 ** rng.random())}" for _ in range(rng.randint(16, 60))]
        items.append((i, " ".join(words)))
        swap = set(rng.sample(range(len(words) - 8), int(len(words) * (0.1, 0.2, 0.3, 0.35)[i % 4]))) if len(words) > 24 else set()
        at = rng.randrange(len(docs[i % 24]))
        docs[i % 24][at:at] = [f"w{int(50_000 ** rng.random())}" if k in swap else w for k, w in enumerate(words)]
        want.add((i % 24, i))
    got = found(spark, [(i, " ".join(t)) for i, t in enumerate(docs)], items)
    assert len(want & got) >= 0.9 * len(want), want - got


def confirmed(docs, items):
    """Pairs of which some window at a step of STEP words is confirmed by its words, whatever its cosine."""
    out = set()
    held = D.Items(items, np.ones((D.SLOTS, 4), np.float32), np.ones(D.SLOTS, np.int64))
    for d, text in docs:
        words, _ = held.numbers([[w.encode() for w in text.lower().split()]])
        for k, item in enumerate(held.ids):
            width = int(held.width[k])
            for a in range(0, max(1, len(words)), D.STEP):
                own = words[max(0, a - width // 2) : min(len(words), a + width + width // 2)].tolist()
                share, answer = held.confirm(k, own)
                if share >= D.SHARE and answer >= D.ANSWER:
                    out.add((d, item))
                    break
    return out


def test_all_windows_by_brute_force(spark):
    rng = random.Random(36)
    items, docs = [], []
    for i in range(40):
        words = prose(rng, rng.randint(10, 50)).split()
        items.append((i, " ".join(words)))
        swap = set(rng.sample(range(len(words)), int(len(words) * rng.choice((0.0, 0.1, 0.3, 0.4, 0.5)))))
        docs.append((i, " ".join([*prose(rng, rng.randint(0, 200)).split(), *("zz" if k in swap else w for k, w in enumerate(words)), *prose(rng, rng.randint(0, 200)).split()])))
    docs += [(100 + i, prose(rng, 400)) for i in range(30)]
    want, got = confirmed(docs, items), found(spark, docs, items)
    assert got <= want and len(want & got) >= 0.95 * len(want), (got - want, want - got)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(37)
    items = [(i, prose(rng, 6 + i)) for i in range(30)]
    docs = [(i, prose(rng, 80) + " " + items[i][1] + " " + prose(rng, 80)) for i in range(30)]
    whole = found(spark, docs, items)
    assert whole == {(i, i) for i in range(30)}
    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 7)
    assert found(spark, docs, items) == whole
