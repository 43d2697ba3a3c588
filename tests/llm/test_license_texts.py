"""Licence scans against a scan by definition: every chain of long enough matches, found without an automaton."""

from __future__ import annotations

import os
import random
import re

import pytest

from quarrymill.llm import licenses


def slow(text):
    """Labels and spans of one text: maximal matches by comparing all places, chained as the docstring says."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    out = []
    for label, texts in licenses.TEMPLATES.items():
        for t in texts:
            own, least = t.split(), licenses.least_of(len(t.split()))
            places = set()
            for i in range(len(words)):
                for j in range(len(own)):
                    if words[i] == own[j] and not (i and j and words[i - 1] == own[j - 1]):
                        n = 0
                        while i + n < len(words) and j + n < len(own) and words[i + n] == own[j + n]:
                            n += 1
                        if n >= least:
                            places.add(i - j)
            runs = set()
            for p in places:
                k = 0
                while k < len(own):
                    n = 0
                    while k + n < len(own) and 0 <= p + k + n < len(words) and words[p + k + n] == own[k + n]:
                        n += 1
                    if n >= licenses.join_of(len(own)):
                        runs.add((p + k, p + k + n, k))
                    k += n + 1
            found = []
            order = sorted(runs)

            def grow(chain, n, order=order, found=found):
                """Every chain, by trying all runs behind its last one."""
                found.append((n, chain[0][0], chain[-1][1]))
                x, y, at = chain[-1]
                for r in order:
                    if r[0] > x and r[2] > at and r[0] - y <= licenses.GAP:
                        new = r[1] - r[0] - max(0, y - r[0], at + y - x - r[2])
                        if new > 0:
                            grow([*chain, r], n + new)

            for r in order:
                grow([r], r[1] - r[0])
            taken = []
            for n, first, end in sorted(found, key=lambda c: (-c[0], c[1], c[2])):
                if n >= licenses.COVER * len(own) and all(end <= f or first >= e for _, f, e, _ in taken):
                    taken.append((label, first, end, n / len(own)))
            out += taken
    return words, sorted(out)


def test_whole_templates_are_found_where_they_stand(spark):
    rng = random.Random(71)
    filler = "alpha beta gamma delta omega river stone cloud software license copyright the of this".split()
    rows, want = [], {}
    for i, (label, texts) in enumerate(licenses.TEMPLATES.items()):
        for k, t in enumerate(texts):
            cut = rng.randint(0, 30)
            body = [rng.choice(filler) for _ in range(60)]
            doc = " ".join(body[:cut]) + "\n" + t.upper().replace(" ", ", ") + ".\n" + " ".join(body[cut:])
            rows.append((100 * i + k, doc))
            want[100 * i + k] = label
    rows += [(9001, " ".join(rng.choice(filler) for _ in range(3000))), (9002, None), (9003, ""), (9004, "x" * 100_000), (9001, rows[0][1])]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, labels string, n_words int")
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in want:
            words, spans = slow(dict(rows[:-1])[r.doc_id])
            assert r.n_words == len(words) and want[r.doc_id] in r.labels.split(",")
            assert sorted((s.label, s.first, s.end, s.cover) for s in r.spans) == spans
        elif r.doc_id != 9001:
            assert r.labels == "" and r.score == 0
    assert licenses.scan(docs.where("false")).count() == 0


def test_gaps_and_parts(spark):
    words = licenses.TEMPLATES["mit"][-1].split()
    most, few = list(words), list(words[: len(words) // 2])
    most[40:42] = ["changed", "here"]
    rows = spark.createDataFrame([(1, " ".join(most)), (2, " ".join(few)), (3, " ".join(words[::-1]))], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert got[1].labels == "mit" and 0.9 < got[1].score < 1 and got[2].labels == got[3].labels == ""


def test_edited_copies_are_found(spark):
    """One word in forty replaced, by words of the licences and by others: 0.9 of the copies of each text are found."""
    rng = random.Random(72)
    known = sorted({w for texts in licenses.TEMPLATES.values() for t in texts for w in t.split()})
    rows, kind = [], {}
    for label, texts in licenses.TEMPLATES.items():
        for t in texts:
            if len(t.split()) < 12:
                continue
            for _ in range(60):
                words = [(rng.choice(known) if rng.random() < 0.5 else "zzz") if rng.random() < 1 / 40 else w for w in t.split()]
                kind[len(rows)] = label, t
                rows.append((len(rows), " ".join(["some", "words", "before", *words, "and", "after"])))
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by: dict = {}
    for d, (label, t) in kind.items():
        by.setdefault((label, t), []).append(label in got[d])
    assert {k[0]: sum(v) / len(v) for k, v in by.items() if sum(v) < 0.9 * len(v)} == {}


def test_a_scan_by_definition_of_edited_copies(spark):
    rng = random.Random(73)
    rows = []
    for i, t in enumerate(t for texts in licenses.TEMPLATES.values() for t in texts):
        words = t.split()
        for _ in range(1 + len(words) // 20):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 2)] = ["the"] * rng.randint(0, 2)
        rows.append((i, " ".join(["license", *words, "the", "license"])))
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert sorted((s.label, s.first, s.end, s.cover) for s in r.spans) == slow(rows[r.doc_id][1])[1]


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence files here")
def test_templates_of_files(spark):
    more = licenses.templates_of(spark, "/usr/share/common-licenses/Apache-2.0")
    text = open("/usr/share/common-licenses/Apache-2.0").read()
    got = licenses.scan(spark.createDataFrame([(1, "intro " + text), (2, "plain")], "doc_id long, text string"), more).collect()
    assert [r.labels for r in sorted(got)] == ["apache-2.0", ""]
