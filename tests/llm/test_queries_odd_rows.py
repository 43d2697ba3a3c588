"""The registered queries over tables with nulls, empty and long texts, repeated rows, no rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import prose, shingles
from test_runs import brute as by_runs
from tokenizers import Tokenizer

import corpus_pipeline
from quarrymill.llm import queries

NAMES = ("n_lines _doc _row _gone _left _c _p text_ words sketch root key _words _l _s _own _pool _limits _rest _stratum h g a b r q row s ids n_tokens n_words labels score kept component_id").split()
QUERIES = queries.queries()
DOCS = [n for n in QUERIES if n not in ("op9_chat", "op12_vector_codes", "op13_whitening")]


def held():
    rng = random.Random(81)
    base, lines = prose(rng, 120), "\n".join(prose(rng, 9) for _ in range(8))
    out = [(i, prose(rng, rng.randint(40, 90)), ("en", "de", None)[i % 3], "s") for i in range(30)]
    out += [(40, base, "en", None), (41, base, "en", "s"), (42, base + " end", "en", "s"), (43, lines, "en", "s"), (44, "top\n" + lines, None, "s"), (43, lines, "en", "s")]
    out += [(50, None, None, None), (51, "", "", ""), (52, " \n\t", "en", "s"), (None, base, "en", "s"), (None, None, None, None), (53, "y" * 60_000, "en", "s"), (54, "ab cd " * 9000, "de", "s"), (55, "é ß 中 😀 ՘", "fr", "s")]
    return out


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame([(d, t, l, s, len(t or "")) for d, t, l, s in held()], "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit("clash") for n in NAMES})
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (1, None, None), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, " ".join(held()[3][1].split()[5:30])), (1, None), (2, ""), (None, held()[4][1])], "item_id long, text string").withColumn("doc_id", F.lit(1))
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "x" * 50_000), (None, None, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", "")], "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(0))
    vectors = [(i, [float((i * k) % 7) / 8 for k in range(8)], i % 3) for i in range(20)] + [(3, [0.0] * 8, None), (None, [0.5] * 8, None), (30, None, 1), (31, [None] * 8, 1), (32, [float("nan")] * 8, 1), (33, [float("-inf")] * 8, 1), (34, [], 1), (35, [0.5] * 3, 1)]
    vectors = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumns({n: F.lit("clash") for n in ("x", "id", "code", "error", "n", "component")})
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items), ("conversations", turns), ("embeddings", vectors)):
        df.repartition(2).write.parquet(f"{top}/odd/{name}.parquet")
        df.limit(0).write.parquet(f"{top}/none/{name}.parquet")
    return top


@pytest.fixture(scope="module")
def results(spark, folders):
    made = {}

    def of(name):
        if name not in made:
            made[name] = QUERIES[name](spark, f"{folders}/odd").collect()
        return made[name]

    return of


@pytest.mark.parametrize("name", DOCS)
def test_a_row_for_each_row(results, name):
    got = results(name)
    if name != "op8_decontaminate":
        key = lambda x: (x is None, x or 0)
        assert sorted((r.doc_id for r in got), key=key) == sorted((d for d, *_ in held()), key=key)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folders, name):
    assert QUERIES[name](spark, f"{folders}/none").count() == (1 if name == "op9_chat" else 0)


def test_op1(results):
    want = sorted((d or -1, n, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, n in by_runs([(d, t) for d, t, *_ in held()]).elements())
    assert sorted((r.doc_id or -1, r.n_removed_lines, r.kept_sha256) for r in results("op1_line_dedup")) == want


def test_op2(results):
    sizes = {d: len(shingles(t)) for d, t, *_ in held() if d is not None}
    got = {r.doc_id: r for r in results("op2_near_dedup") if r.doc_id is not None}
    assert {d: r.n_shingles for d, r in got.items()} == sizes and got[41].component_id == got[42].component_id == 40 and not got[41].kept


def test_op3_and_op6(results):
    words, parts = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    ids = lambda t, x: np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4")
    want = sorted((d or -1, len(i := ids(words, t)), hashlib.sha256(i.tobytes()).hexdigest(), hashlib.sha256(words.decode(i, skip_special_tokens=False).encode()).hexdigest()) for d, t, *_ in held())
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in results("op3_bpe")) == want
    want = sorted((d or -1, len(i := np.append(ids(parts, t), np.uint32(0)).astype("<u4")), zlib.crc32(i.tobytes())) for d, t, *_ in held())
    got = results("op6_packed_ids")
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == want
    ends = sorted((r.start, r.start + r.n_tokens, (r.doc_id is not None, r.doc_id or 0)) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] and a[2] <= b[2] for a, b in zip(ends, ends[1:], strict=False))


def test_op4(results):
    for r in results("op4_substrings"):
        assert r.n_bytes - r.n_removed == len(r.text.encode()) or "�" in r.text
        assert (r.n_spans == 0) == (r.n_removed == 0)
    assert {r.n_removed > 0 for r in results("op4_substrings") if r.doc_id in (40, 41, 43, 53, 54)} == {True}
    texts, seen = [(d, (t or "").encode()) for d, t, *_ in held()], Counter()
    for _, t in texts:
        seen.update(t[i : i + 400] for i in range(len(t) - 399))
    want = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i] += 1
                gone[min(len(t), i + 400)] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((-1 if d is None else d, len(t), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1)), hashlib.sha256(left).hexdigest()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in results("op4_substrings")) == sorted(want)


def test_op11(results):
    got = results("op11_mixing")
    want = sorted((d or -1, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, *_ in held())
    assert sorted((r.doc_id or -1, r.size) for r in got) == want
    assert all(r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0 for r in got)


def test_op12_and_op13(results):
    kept = sorted([*range(20), 3, -1])
    assert sorted(-1 if r.vec_id is None else r.vec_id for r in results("op12_vector_codes")) == kept
    assert {(r.error, len(r.code)) for r in results("op12_vector_codes")} == {(0, 8)}
    got = results("op13_whitening")
    assert {-1 if r.vec_id is None else r.vec_id for r in got} == set(kept) and {r.identity_error < 1e-4 for r in got} == {True}


def test_pipeline(spark, folders):
    assert corpus_pipeline.run(spark, f"{folders}/none").count() == 0
    got = corpus_pipeline.run(spark, f"{folders}/odd").collect()
    ids = [r.doc_id for r in got]
    assert len(ids) >= 3 and set(ids) <= {d for d, *_ in held()}
    assert not {41, 42, 50, 51, 52} & set(ids)  # near copies, and texts without words


def test_op7_op8_op10(results):
    assert {r.lang_pred for r in results("op7_language_id") if r.doc_id in (50, 51, 52)} == {"und"}
    assert (3, 1) in {(r.doc_id, r.item_id) for r in results("op8_decontaminate")}
    by = {r.doc_id: r for r in results("op10_quality")}
    assert by[50].base_failed and by[50].n_words == 0 and by[54].base_failed and not by[54].kept
