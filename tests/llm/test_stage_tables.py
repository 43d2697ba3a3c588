"""What the pipeline's stages write beside their results."""

from __future__ import annotations

import random

from test_links import classes, found
from test_operators import prose

from quarrymill.llm import minhash, quality
from quarrymill.llm._store import written


def test_quality_writes_no_texts(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(quality, "written", lambda df: kept.append(df.columns) or df)
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng, 60), "en", i) for i in range(30)] + [(30, "short", None, 1)], "doc_id long, text string, lang string, other int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    out = quality.assess(docs, labels)
    assert sorted(r.doc_id for r in out.where("kept").collect()) == list(range(30)) and out.columns[:4] == docs.columns
    assert kept and not any("text" in c for c in kept)


def test_groups_of_one_component_and_few_others_need_no_differences(spark, monkeypatch):
    rng = random.Random(17)
    base, held = prose(rng, 160).split(), []
    for i in range(60):
        w = list(base)
        w[rng.randrange(60, 160)] = f"edit{i}"
        held.append(w)
    held += [base[:100] + [f"own{i}x{k}" for k in range(60)] for i in range(6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rng.sample(held, len(held)))]

    def called(*_):
        raise AssertionError("differences of a group that pairs can close")

    monkeypatch.setattr(minhash, "differences", called)
    assert found(spark, rows) == classes(rows)


def test_the_driver_collects_its_garbage_between_tables(spark):
    def whole():
        """Collections of the whole heap so far; young ones leave large buffers and grow the heap instead."""
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "Mark" in b.getName())

    before = whole()
    for i in range(24):
        assert written(spark.range(i)).count() == i
    assert whole() >= before + 3
