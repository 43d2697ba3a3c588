"""The ten operators against brute force, round trips and defined cases, over a small table with every odd kind of row."""

from __future__ import annotations

import collections
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrymill.llm import bpe, chat, decontaminate, langid, licenses, line_dedup, minhash, packing, quality, substrings
from quarrymill.llm._text import pieces

WORDS = "alpha beta gamma delta omega river stone cloud paper light night spring water glass field house voice dream chair table".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


def rows():
    rng = random.Random(5)
    base, passage = prose(rng, 300), prose(rng, 120)
    lines = "\n".join(prose(rng, 6) for _ in range(40))
    out = [(i, prose(rng, rng.randint(60, 200))) for i in range(10)]
    words = base.split()
    for i in range(10, 70):  # a group of near copies longer than the short lists
        w = list(words)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**9)}"
        out.append((i, " ".join(w)))
    out += [(70, base), (71, base.upper()), (72, None), (73, ""), (74, " \n\t "), (75, "one two"), (76, "One TWO"), (77, "x" * 5000), (78, "ab " * 4000)]
    out += [(79, prose(rng, 50) + " " + passage + " " + prose(rng, 50)), (80, prose(rng, 30) + " " + passage), (81, lines), (82, "intro\n" + lines + "\nend"), (83, passage + "\n" + lines)]
    out += [(84, "é😀ß " * 300), (85, "it's <|endoftext|> don't ÀÉ"), (85, "it's <|endoftext|> don't ÀÉ"), (None, base), (None, None), (86, lines), (86, lines)]
    return [(d, t, "en" if (d or 0) % 2 else None, 7, "clash") for d, t in out]


SCHEMA = "doc_id long, text string, lang string, n_shingles int, n_words string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(docs, empty):
    held = [(d, shingles(t)) for d, t, *_ in rows() if d is not None]
    root = {d: d for d, _ in held}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(held):
        for b, y in held[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows())
    sizes = dict(held)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sizes[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
        else:
            assert r.kept and r.component_id is None
    assert minhash.near_duplicates(empty).count() == 0


def test_long_lists_lose_no_link(docs, monkeypatch):
    want = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(minhash, "SHORT", 2)
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe(docs, name):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), bpe.load(path)
    rng = random.Random(2)
    texts = [t or "" for _, t, *_ in rows()] + ["".join(rng.choice("abc  \n'!0étß中😀 ") for _ in range(rng.randint(1, 50))) for _ in range(300)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        ids = np.frombuffer(own.encode(t), "<u4")
        assert ids.tolist() == want
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False)
    got = bpe.encode(docs, path, decoded=True).collect()
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.decoded_text == library.decode(want, skip_special_tokens=False)


def test_substrings(docs, empty):
    held = [(d, (t or "").encode()) for d, t, *_ in rows()]
    count = collections.Counter(b[i : i + 400] for _, b in held for i in range(len(b) - 399))
    want = collections.Counter()
    for d, b in held:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        want[d, len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    got = substrings.dedup(docs).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, sum(x.end - x.first for x in r.removed), bytes(r.kept)) for r in got) == want
    assert substrings.dedup(empty).count() == 0


def test_hot_anchors_lose_nothing(docs, monkeypatch):
    want = sorted((r.doc_id or -1, bytes(r.kept)) for r in substrings.dedup(docs).collect())
    monkeypatch.setattr(substrings, "HOT", 0)
    assert sorted((r.doc_id or -1, bytes(r.kept)) for r in substrings.dedup(docs).collect()) == want


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(100):
        b = bytes(rng.choice(b"ab\0c") for _ in range(rng.randint(1, 60)))
        t = np.frombuffer(b, np.uint8)
        order = substrings.suffix_array(t, 64)
        assert [b[i:] for i in order] == sorted(b[i:] for i in range(len(b)))
        shared = substrings.common_prefixes(t, order, 64)
        for k in range(1, len(b)):
            x, y = b[order[k] :], b[order[k - 1] :]
            assert shared[k] == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def chunks_of(text):
    """Chunks by definition; xxhash64 with Spark's seed."""
    mask = (1 << 64) - 1
    lines = text.split("\n")
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in lines]
    out, at = [], 0
    for i in range(len(lines)):
        roll = h[i]
        for back in (1, 2):
            if i >= back:
                v = h[i - back]
                roll ^= (v << back | v >> (64 - back)) & mask
        end = xxhash.xxh64((roll).to_bytes(8, "little"), seed=42).intdigest() & 3 == 0
        if end or i == len(lines) - 1:
            out.append("\n".join(lines[at : i + 1]))
            at = i + 1
    return out


def test_line_dedup(docs, empty):
    held = [(d, t) for d, t, *_ in rows()]
    owner, count = {}, collections.Counter()
    ok = lambda c: "\n" in c and re.search(r"[^\x20\x09-\x0D]", c)
    for d, t in held:
        for c in chunks_of(t or ""):
            if ok(c):
                count[c] += 1
                owner[c] = min(owner.get(c, math.inf), math.inf if d is None else d)
    want = collections.Counter()
    for d, t in held:
        seen, kept = set(), []
        for c in chunks_of(t) if t is not None else ():
            if ok(c) and count[c] > 1 and not ((math.inf if d is None else d) == owner[c] and c not in seen):
                continue
            seen.add(c)
            kept.append(c)
        want[d, "\n".join(kept) if t is not None else None] += 1
    got = line_dedup.dedup(docs)
    assert got.columns[:5] == docs.columns
    got = got.collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == want
    assert sum(r.n_removed_lines for r in got) > 60
    assert line_dedup.dedup(empty).count() == 0


def test_quality_counts(docs, empty):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)

    got = quality.measure(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert collections.Counter((r.doc_id, *(r[c] for c in names)) for r in got) == collections.Counter((d, *brute(t)) for d, t, *_ in rows())
    assert quality.measure(empty).count() == 0


def test_quality_bounds(spark):
    cases = [(n, k, p) for n in (1, 20, 400, 3000) for k in (0, 1, 3, 7) for p in (0.01, 0.05) if k <= n]
    for n, k, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        want = 1.0 if k >= n * p else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-8)


def test_quality_verdicts(spark):
    rng = random.Random(4)
    good = [(i, prose(rng, 80), "en", "g") for i in range(3000)]
    bad = [(10_000 + i, " ".join(w + "###" for w in prose(rng, 80).split()), "en", "b") for i in range(300)]
    docs = spark.createDataFrame(good + bad + [(20_000, None, None, "x"), (20_001, "short", "en", "x")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 3000)] + [(10_000 + i, 0, 0) for i in range(0, 300, 2)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.assess(docs, labels).collect()}
    assert sum(got[d].kept for d, *_ in good) >= 2850
    assert not any(got[d].kept for d, *_ in bad)
    assert got[20_000].base_failed and not got[20_000].kept and got[20_001].base_failed
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept == (not r.base_failed) for r in quality.assess(docs, none).collect())


def test_licenses(spark, empty):
    texts = ["Released under the MIT License. Body text.", "All rights reserved, all rights reserved", "General Public License", "licensed under cc by-nc 4.0", "plain words", "", None, "alls rights reserved"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[0].labels == "mit" and got[0].n_base == 0 and got[0].first_word is None and got[0].score == 1.0
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 0, 3, "reserved")
    assert got[2].base_labels == "gpl" and got[3].base_labels == "cc-by" and "cc-by-nc" in got[3].labels
    assert got[4].labels == got[5].labels == got[6].labels == got[7].base_labels == "" and got[6].n_words == 0
    assert licenses.scan(empty).count() == 0


def test_matching_statistics():
    rng = random.Random(6)
    for _ in range(60):
        auto, held = licenses.SuffixAutomaton(), []
        for i in range(3):
            held.append([rng.randint(1, 3) for _ in range(rng.randint(1, 12))])
            auto.add(held[-1], i)
        auto.finish()
        text = [rng.randint(1, 4) for _ in range(30)]
        for i, (state, n) in enumerate(auto.statistics(text)):
            ends = lambda m: {(k, e) for k, s in enumerate(held) for e in range(m, len(s) + 1) if m and s[e - m : e] == text[i + 1 - m : i + 1]}  # noqa: B023, E731
            want = max((m for m in range(i + 2) if m == 0 or ends(m)), default=0)
            assert n == want and (not n or set(auto.ends[state]) == ends(n))


@pytest.mark.parametrize("vocabulary", [2, 300, 50257, 65536, 100_000, 1 << 32])
def test_packing(vocabulary):
    rng = np.random.default_rng(1)
    held = [rng.integers(0, vocabulary, n).astype(np.uint32) for n in (5, 0, 100, 1, 77)]
    out = io.BytesIO()
    writer = packing.PackedWriter(out, vocabulary, block=32)
    for x in held:
        writer.add(x)
    writer.close()
    reader = packing.PackedReader(out)
    assert reader.bits == max(1, (vocabulary - 1).bit_length()) and reader.total == sum(map(len, held))
    for i in (4, 0, 2, 1, 3):
        assert reader.document(i).tolist() == held[i].tolist()
    assert reader.ids(40, 70).tolist() == np.concatenate(held)[40:70].tolist()


def test_packed_files(docs, empty):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    folder, files = packing.write(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), 50257, 0, 4)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in packing.read_digests(docs, folder, files).collect())
    want, at = [], 0
    for d, t in sorted(((d, t or "") for d, t, *_ in rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    folder, files = packing.write(empty, public_tokenizers.path("byte_bpe_50k.tiktoken"), 50257, 0, 4)
    assert packing.read_digests(empty, folder, files).count() == 0


def test_a_task_writes_several_files(spark, monkeypatch):
    monkeypatch.setattr(packing, "FILE_BYTES", 3000)
    monkeypatch.setattr(packing, "pieces", lambda batch: pieces(batch, most=700))
    rng = random.Random(91)
    docs = spark.createDataFrame([(i, prose(rng, rng.randint(0, 60))) for i in range(300)], "doc_id long, text string").repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder, files = packing.write(docs, path, 50257, 0, 4)
    assert files.count() > 12 and files.select("part").distinct().count() == 4
    one = packing.read_digests(docs, *packing.write(docs, path, 50257, 0, 1)).collect()
    assert sorted(packing.read_digests(docs, folder, files).collect()) == sorted(one)


def test_language(spark):
    rng = random.Random(8)
    de, en = "der die das und nicht ein schön über straße".split(), "the and of with that which through would".split()
    make = lambda w: " ".join(rng.choice(w) + rng.choice(w)[:2] for _ in range(40))
    held = [(i, make(de if i % 2 else en), "de" if i % 2 else "en") for i in range(400)]
    docs = spark.createDataFrame([*held, (900, None, "en"), (901, "", None), (902, "12 34 !!", "de"), (903, "… — 😀", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    out = [d for d, *_ in held if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d].held_out for d in out) and sum(r.held_out for r in got.values()) >= len(out)
    assert sum(got[d].lang_pred == ("de" if d % 2 else "en") for d in out) >= 0.98 * len(out)
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (900, 901, 902, 903))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_decontamination(spark, empty):
    rng = random.Random(9)
    items = [(i, prose(rng, 30) + ". Answer " + prose(rng, 5)) for i in range(8)]
    edited = items[1][1].split()
    edited[3::6] = ["changed"] * len(edited[3::6])
    held = [(i, prose(rng, 150)) for i in range(30)]
    held += [(100, prose(rng, 60) + " " + items[0][1] + " " + prose(rng, 60)), (101, prose(rng, 40) + " " + " ".join(edited) + " " + prose(rng, 40)), (102, items[2][1].upper()), (103, None), (104, "")]
    docs = spark.createDataFrame(held, "doc_id long, text string")
    benchmark = spark.createDataFrame([*items, (50, None), (51, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(100, 0), (101, 1), (102, 2)}
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.where("item_id < 0")).count() == 0


def test_common_subsequence():
    rng = random.Random(10)
    for _ in range(100):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == table[-1][-1]


def test_chat(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    held = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", odd), (2, 1, "assistant", "\\<|x\\\\|>"), (3, 0, None, None), (None, 0, "we\nird\\", "é😀"), (None, None, "assistant", "t"), (4, 0, "user", "q"), (4, 0, "user", "q"), (5, 0, "assistant", "<|endoftext|>\n")]
    df = spark.createDataFrame(held, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df, path), path).collect()}
    for c in {h[0] for h in held}:
        turns = sorted(((t, r or "", x or "") for k, t, r, x in held if k == c), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    texts = [r.formatted for r in chat.formatted(df, path).where("conv_id = 2").collect()]
    assert texts[0].count(chat.START) == texts[0].count(chat.END) == 2
    assert chat.formatted(df.where("conv_id > 9"), path).count() == 0
