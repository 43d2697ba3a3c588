"""Language shares against a slow expectation-maximisation, word by word."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from quarrymill.llm import langid


def slow(words, langs):
    """Shares of one text: words are rows of likelihoods."""

    def fit(some):
        share = [1 / len(some) if k in some else 0.0 for k in range(langs)]
        for _ in range(langid.ROUNDS if len(some) > 1 else 0):
            new = [0.0] * langs
            for w in words:
                total = sum(w[k] * share[k] for k in range(langs))
                for k in range(langs):
                    new[k] += w[k] * share[k] / total
            share = [x / len(words) for x in new]
        return share, sum(math.log(sum(w[k] * share[k] for k in range(langs))) for w in words)

    some = set(range(langs))
    share, level = fit(some)
    while len(some) > 1:
        few = {k for k in some if share[k] * len(words) < 0.5}
        left = some - few if few and few != some else some - {min(some, key=lambda k: share[k])}
        new, lost = fit(left)
        if level - lost >= (len(some) - len(left)) * 0.5 * math.log(max(len(words), 2)):
            break
        some, share, level = left, new, lost
    return share


def test_mixture():
    rng = random.Random(61)
    texts = []
    for _ in range(60):
        main = rng.sample(range(4), rng.randint(1, 3))
        rows = [[math.exp(rng.uniform(-9, 0)) for _ in range(4)] for _ in range(rng.choice((1, 2, 7, 40)))]
        for r in rows:
            r[rng.choice(main)] = 1.0
        texts.append(rows * rng.choice((1, 1, 2)))
    like = np.array([w for t in texts for w in t])
    of = np.repeat(np.arange(1, len(texts) + 1), [len(t) for t in texts])
    got = langid.mixture(like, np.ones(len(like)), of, len(texts) + 2)
    assert not got[0].any() and not got[-1].any()
    for row, t in zip(got[1:], texts, strict=False):
        assert np.allclose(row, slow(t, 4), atol=1e-9)
    twice = langid.mixture(like, np.full(len(like), 2.0), of, len(texts) + 1)
    assert np.allclose(twice[1], slow(texts[0] * 2, 4), atol=1e-9)


def test_odd_rows(spark):
    rng = random.Random(62)
    de, en = "der die das und nicht ein schön über straße".split(), "the and of with that which through would".split()
    make = lambda w, n: " ".join(rng.choice(w) + rng.choice(w)[:2] for _ in range(n))
    held = [(i, make((en, de)[i % 2], 30), ("en", "de")[i % 2]) for i in range(300)]
    held += [(700, make(de, 30) + " " + make(en, 30), None), (701, make(de, 20_000), None), (702, "x" * 100_000, None), (703, None, None), (None, make(en, 30), "en"), (5, held[5][1], "de"), (5, held[5][1], "de")]
    docs = spark.createDataFrame(held, "doc_id long, text string, lang string").withColumns({"score": F.lit("clash"), "lang_pred": F.lit(1), "_n": F.lit(2)})
    got = langid.identify(docs).collect()
    of = {r.doc_id: r for r in got}
    assert len(got) == len(held) and of[701].lang_pred == "de" and of[703].lang_pred == "und" and of[None].lang_pred == "en"
    assert {x.lang for x in of[700].languages} == {"de", "en"} and abs(sum(x.share for x in of[700].languages) - 1) < 1e-6
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 5}) == 1
    assert langid.identify(docs.where("false")).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    """130 languages of made-up syllables, the model in blocks of 32."""
    rng = random.Random(63)
    sounds = [a + b for a in "bcdfghjklmnpqrstvwxz" for b in "aeiou"]
    own = {f"l{k:03d}": rng.sample(sounds, 6) for k in range(130)}
    held = [(i, " ".join("".join(rng.choice(own[lang]) for _ in range(rng.randint(2, 4))) for _ in range(40)), lang) for i, lang in enumerate(x for x in own for _ in range(8))]
    docs = spark.createDataFrame(held, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "BLOCK", 32)
    blocks = langid.identify(docs).select("doc_id", "lang_pred", "held_out", "score").collect()
    monkeypatch.setattr(langid, "BLOCK", 500)
    whole = sorted(langid.identify(docs).select("doc_id", "lang_pred", "held_out", "score").collect())
    assert [x[:3] for x in sorted(blocks)] == [x[:3] for x in whole] and np.allclose([x[3] for x in sorted(blocks)], [x[3] for x in whole])
    out = [r.lang_pred == held[r.doc_id][2] for r in blocks if r.held_out]
    assert len(out) > 200 and sum(out) >= 0.95 * len(out)
