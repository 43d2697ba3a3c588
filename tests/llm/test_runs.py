"""Line dedup of whole runs against brute force over pairs of lines, without chunk borders."""

from __future__ import annotations

import collections
import math
import random
import re

from test_operators import SCHEMA, prose, rows

import corpus_pipeline
from quarrymill.llm import line_dedup


def brute(docs):
    """(doc_id, text, lines gone) of each row."""
    held = [(math.inf if d is None else d, t.split("\n") if t is not None else None) for d, t in docs]
    pairs = lambda x: [(i, p) for i, p in enumerate(zip(x or (), (x or ())[1:], strict=False)) if re.search(r"[^\x20\x09-\x0D]", "".join(p))]
    count, owner = collections.Counter(), {}
    for d, x in held:
        for _, p in pairs(x):
            count[p] += 1
            owner[p] = min(owner.get(p, d), d)
    out = collections.Counter()
    for (d, x), (id_, t) in zip(held, docs, strict=True):
        first, gone = {}, set()
        for i, p in pairs(x):
            first.setdefault(p, i)
            if count[p] > 1 and (owner[p] != d or i > first[p] + 1):
                gone.add(i)
        runs: list[list[int]] = []
        for i in sorted(gone):
            if runs and i <= runs[-1][1] + 1:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
        words = lambda a, z, x=x: sum(len(re.findall(r"[^\x20\x09-\x0D]+", y)) for y in x[a : z + 1])
        gone = {i for a, z in runs if words(a, z) >= line_dedup.LEAST_WORDS for i in range(a, z + 1)}
        out[id_, t if not gone else "\n".join(y for i, y in enumerate(x) if i not in gone), len(gone)] += 1
    return out


def test_whole_runs(spark):
    rng = random.Random(21)
    own = lambda n: [prose(rng, 6) for _ in range(n)]
    passages = [own(n) for n in (2, 2, 3, 3, 4, 4, 5, 5, 9)]
    docs = [(i, "\n".join(own(4) + p + own(3))) for i, p in enumerate(passages * 3)]
    docs += [(100, "a\na\na"), (101, "b\nb\nb\nb"), (102, "x\n\ny\nz\n\nx\n\ny"), (103, "\n\n\n"), (104, "\n\n\n"), (None, "\n".join(passages[0])), (None, None), (105, "")]
    got = line_dedup.dedup_runs(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert collections.Counter((r.doc_id, r.text, r.n_removed_lines) for r in got) == brute(docs)
    copies = {r.doc_id: r for r in got if r.doc_id is not None and len(passages) <= r.doc_id < 100}
    assert all(r.n_removed_lines == len(passages[d % len(passages)]) and r.n_removed_chunks == 1 for d, r in copies.items())
    left = {y for r in got for y in (r.text or "").split("\n")}
    assert all(y in left for _, t in docs for y in (t or "").split("\n") if y)


def test_odd_rows(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = line_dedup.dedup_runs(docs)
    assert got.columns[:5] == docs.columns
    assert collections.Counter((r.doc_id, r.text, r.n_removed_lines) for r in got.collect()) == brute([(d, t) for d, t, *_ in rows()])
    assert line_dedup.dedup_runs(docs.where("false")).count() == 0


def test_lines_that_share_a_hash_stay(spark, monkeypatch):
    five = " a b c d e"
    docs = spark.createDataFrame([(i, "\n".join(x + five for x in ("one", "two", "three", "four"))) for i in range(3)], "doc_id long, text string")
    odd = docs.selectExpr(f"xxhash64('two{five}') AS h").limit(1)
    monkeypatch.setattr(line_dedup, "_ambiguous", lambda _: odd)
    short = f"one{five}\ntwo{five}"
    assert sorted(r.text for r in line_dedup.dedup_runs(docs).collect()) == [short, short, docs.first().text]


def test_headings_and_short_lists_stay(spark):
    held = [(1, "Usage\n\nalpha beta gamma one"), (2, "Usage\n\ndelta epsilon zeta two"), (3, "- yes\n- no\nunique three"), (4, "- yes\n- no\nunique four")]
    held += [(5, "top\nthis line and the next one are said\nby several documents of this small table\nfive"), (6, "this line and the next one are said\nby several documents of this small table"), (7, "one paragraph of more than ten words with a blank line behind it\n\nseven"), (8, "one paragraph of more than ten words with a blank line behind it\n\neight")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_runs(spark.createDataFrame(held, "doc_id long, text string")).collect()}
    assert got == dict(held) | {6: "", 8: "eight"}


def test_pipeline_keeps_documents_with_words_of_their_own(spark):
    rng = random.Random(22)
    shared, header = "\n".join(prose(rng, 20) for _ in range(80)), prose(rng, 8) + "\n" + prose(rng, 7)
    own = {2: prose(rng, 400), 3: prose(rng, 45), 4: "four words are left"}
    held = [(0, shared), (1, header), (2, shared + "\n" + own[2]), (3, header + "\n" + own[3]), (4, own[4] + "\n" + shared), (5, shared)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in held], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_deduplication(spark, docs, "").collect()}
    assert got == {d: (t, len(t)) for d, t in [*held[:2], *own.items()]}
