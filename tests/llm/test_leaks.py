"""Benchmark items that punctuation, few words or many replaced words must not hide."""

from __future__ import annotations

import random

import pytest
from test_operators import prose

from quarrymill.llm import decontaminate


def found(spark, docs, items):
    hits = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id) for r in hits.collect()}


@pytest.mark.parametrize(("text", "want"), [("A b? C d.", " C d."), ("A b. C d?", " C d?"), ('A b. "C d?"', ' "C d?"'), ("A? b c?)", " b c?)"), ("A b. C d?!", " C d?!"), ("A b. C d??", " C d??"), ("?!", "?!"), ("", "")])
def test_answers_hold_words(text, want):
    assert decontaminate._answer(text) == want


def test_items_that_end_in_a_question(spark):
    rng = random.Random(31)
    items = [(i, "He said. " + prose(rng, 20) + end) for i, end in enumerate(('?"', "?)", "?!", "??", "?", "? ...", '"'))]
    docs = [(i, prose(rng, 60) + " " + t + " " + prose(rng, 60)) for i, t in items] + [(100 + i, prose(rng, 150)) for i in range(20)]
    assert found(spark, docs, items) == {(i, i) for i, _ in items}


def test_short_items_are_found_wherever_they_stand(spark):
    rng = random.Random(32)
    items = [(i, f"Zq{i} " + " ".join(f"short{rng.randint(0, 9)}" for _ in range(i % 7))) for i in range(56)]
    docs = [(i, prose(rng, 50 + i % 9) + " " + t.upper() + " " + prose(rng, 50)) for i, t in items] + [(100, ""), (101, items[13][1].split()[0])]
    want = {(i, i) for i, _ in items}
    for d, t in docs[-2:]:
        want |= {(d, i) for i, x in items if x.strip().lower() == t.lower() and t}
    assert found(spark, docs, items) == want


def test_paraphrases_at_the_share_are_found(spark):
    rng = random.Random(33)
    items, docs = [], []
    for i in range(240):
        words = prose(rng, rng.randint(15, 59) if i % 8 else rng.randint(100, 260)).split()
        items.append((i, " ".join(words) + "?" + " Yes."))
        words.append("Yes.")
        other = rng.sample(range(len(words) - 1), int(len(words) * (0.4, 0.35, 0.3)[i % 3]))
        text = " ".join(f"swap{rng.randint(0, 10**6)}" if k in other else w for k, w in enumerate(words))
        docs.append((i, prose(rng, rng.randint(0, 90)) + " " + text + " " + prose(rng, rng.randint(0, 90))))
    assert {(i, i) for i, _ in items} - found(spark, docs, items) == set()


@pytest.mark.parametrize("swapped", [0.1, 0.2, 0.3, 0.35])
def test_recall_on_real_items(spark, swapped):
    """Items of the benchmark with a share of words replaced, in documents of the corpus: 0.9 or more of those that the words confirm are found."""
    rng = random.Random(34)
    top = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{top}/benchmark.parquet").collect()]
    around = [r.text.split() for r in spark.read.parquet(f"{top}/documents.parquet").where("length(text) > 1500").orderBy("doc_id").limit(40).collect()]
    vocabulary = sorted({w for t in around for w in t})
    docs, sure = [], set()
    judge = decontaminate.Items(items, decontaminate.np.ones((decontaminate.SLOTS, 1), "float32"), decontaminate.np.ones(decontaminate.SLOTS))
    for k, (i, text) in enumerate(items):
        words, host = text.split(), around[k % len(around)]
        for at in rng.sample(range(len(words)), int(len(words) * swapped)):
            words[at] = rng.choice(vocabulary)
        cut = rng.randrange(len(host))
        docs.append((i, " ".join(host[:cut] + words + host[cut:])))
        own, _ = judge.numbers(decontaminate._words(decontaminate.pa.array([" ".join(words)], decontaminate.pa.large_string())))
        share, answer = judge.confirm(k, own.tolist())
        if share >= decontaminate.SHARE and answer >= decontaminate.ANSWER:
            sure.add((i, i))
    assert len(sure) > 25
    assert len(sure & found(spark, docs, items)) >= 0.9 * len(sure)
