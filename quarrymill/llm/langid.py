"""Operator 7: language identification as inference over mixtures of languages.

Each language has a model of hashed byte n-grams, learned from labelled texts. The words of a document are drawn from
a mixture: expectation-maximisation over the words' likelihoods gives the share of each language. Then languages leave
the set, first all that hold less than half a word, then the smallest share, as long as the likelihood lost is less than the
penalty (half the logarithm of the number of words for each language that leaves); the main language of the set that remains is the
prediction, the first in the alphabet of equal ones, and ``languages`` has the whole set with its shares.

Learning takes about ``SAMPLE_ROWS`` labelled rows of each language, whole, chosen by a
hash of doc_id (rows of one doc_id are all in or all out); all other work is on all rows and whole texts. Every language is learned, however many there are: models
are made and sent out ``BLOCK`` languages at a time, and a task holds one block of them at a time. Words are scored once and
kept by each worker, ``STORE_WORDS`` of them at a time. Null text or text without a letter is ``und`` with score 0. Rows with null lang
teach nothing; without any labelled row, as in an empty table, everything is ``und``. Repeated rows get equal predictions; other
columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import written
from ._text import mix, pieces, spans, text_array, utf8

#: Labelled rows of a language that are learned from, about.
SAMPLE_ROWS = 1000
#: Languages of a block of the model, and bytes of text worked on at a time with one block; less with more.
BLOCK = 64
_PIECE = 1 << 19
#: Slots of the hashed n-grams (a power of two) and the longest n-gram.
SLOTS = 1 << 16
LONGEST = 4
#: Rounds of EM.
ROUNDS = 12
#: A word's log-likelihood ratio to its best language is held above this.
FLOOR = -12.0
#: Words that a worker keeps the likelihoods of; beyond it the store starts anew, which changes speed only. Bytes of the longest that is kept.
STORE_WORDS = 1 << 16
STORE_BYTES = 64

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_SPLIT = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if _LETTER[b] else 0x20 for b in range(256))


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of each word, with a blank at both ends, and the word each belongs to."""
    n = ends - starts + 2
    at = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(int(n.sum())) - at[of]
    low = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint64)
    inner = (place > 0) & (place < n[of] - 1)
    letter = np.full(len(of), 32, np.uint64)
    letter[inner] = low[(starts[of] + place - 1)[inner]]
    slots, owners = [], []
    key = letter.copy()
    with np.errstate(over="ignore"):
        for k in range(2, LONGEST + 1):
            key = key[:-1] * np.uint64(257) + letter[k - 1 :]
            fits = place[: len(key)] + k <= n[of[: len(key)]]
            slots.append((mix(key[fits] + np.uint64(k)) & np.uint64(SLOTS - 1)).astype(np.int64))
            owners.append(of[: len(key)][fits])
    return np.concatenate(slots), np.concatenate(owners)


def sample(docs: DataFrame) -> DataFrame:
    """lang and text of the bounded sample of labelled rows: those whose hash is below a threshold from the language's count."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    sizes = written(rows.groupBy("lang").agg(F.count("*").alias("_n")))  # a table of its own, so Spark knows its size and sends it out, as long as it is small; the texts stay where they are
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    return rows.select("lang", "text", place.alias("_p")).join(sizes, "lang").where(F.col("_p") * F.col("_n") < SAMPLE_ROWS).select("lang", "text")


def learn(docs: DataFrame) -> tuple[list[str], Iterator[np.ndarray]]:
    """Languages, and log-probabilities of each slot in each (slots by languages), a block of languages after the other.

    The executors count and add up; a count for each language of a block and slot reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                texts = text_array(batch.column("text").filter(pa.array(langs == lang)))
                for _, piece in pieces(pa.RecordBatch.from_arrays([texts], names=["text"])):
                    data, offsets = utf8(piece)
                    starts, ends, _ = spans(data, offsets, _LETTER)
                    slots, _ = _grams(data, starts, ends) if len(starts) else (np.zeros(0, np.int64), None)
                    counts[lang] = counts.get(lang, np.zeros(SLOTS, np.int64)) + np.bincount(slots, minlength=SLOTS)
                    if len(counts) > BLOCK:
                        yield from of_languages(counts)
        yield from of_languages(counts)

    def of_languages(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, count in counts.items():
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(count[used], pa.int64())], names=["lang", "slot", "n"])
        counts.clear()

    found = written(sample(docs).mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    langs = sorted(r.lang for r in found.select("lang").distinct().collect())  # the languages' names

    def tables() -> Iterator[np.ndarray]:
        for i in range(0, len(langs), BLOCK):
            own = langs[i : i + BLOCK]
            rows = found.where(F.col("lang").isin(own)).toArrow()  # SLOTS rows of each language at most
            table, of = np.full((SLOTS, len(own)), 0.1), {x: k for k, x in enumerate(own)}
            table[rows.column("slot").to_numpy(), [of[x] for x in rows.column("lang").to_pylist()]] += rows.column("n").to_numpy()
            yield np.log(table / table.sum(0)).astype(np.float32)

    return langs, tables()


def mixture(like: np.ndarray, count: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The share of each language in each of n texts. like: a row of likelihoods for each word, count: how often it occurs, of: its text, ascending."""
    langs = like.shape[1]
    words = np.bincount(of, count, n)
    shares = np.zeros((n, langs))
    texts = np.flatnonzero(words)
    allowed = np.ones((len(texts), langs), bool)

    def fit(which: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares and log-likelihoods of some of the texts over the allowed languages."""
        inside = np.zeros(n, bool)
        inside[texts[which]] = True
        rows = np.flatnonzero(inside[of])
        like_, times, local = like[rows], count[rows, None], np.searchsorted(texts[which], of[rows])
        cuts = np.flatnonzero(np.diff(local, prepend=-1))
        share = allowed / allowed.sum(1, keepdims=True)
        for _ in range(ROUNDS if (allowed.sum(1) > 1).any() else 0):
            each = like_ * share[local]
            each *= times / each.sum(1, keepdims=True)
            share = np.add.reduceat(each, cuts, 0) / words[texts[which]][:, None]
        return share, np.add.reduceat(np.log((like_ * share[local]).sum(1)) * times[:, 0], cuts)

    which = np.arange(len(texts))
    share, level = fit(which, allowed) if len(which) else (shares[:0], shares[:0, 0])
    while True:
        which = which[allowed[which].sum(1) > 1]
        if not len(which):
            break
        least = np.zeros((len(which), langs), bool)
        least[np.arange(len(which)), np.where(allowed[which], share[which], np.inf).argmin(1)] = True
        few = allowed[which] & (share[which] * words[texts[which]][:, None] < 0.5)
        few &= ~(few | ~allowed[which]).all(1, keepdims=True)
        smaller = allowed[which] & ~np.where(few.any(1, keepdims=True), few, least)
        new_share, new_level = fit(which, smaller)
        gone = allowed[which].sum(1) - smaller.sum(1)
        better = level[which] - new_level < gone * 0.5 * np.log(np.maximum(words[texts[which]], 2))
        which, smaller, new_share, new_level = which[better], smaller[better], new_share[better], new_level[better]
        allowed[which], share[which], level[which] = smaller, new_share, new_level
    shares[texts] = np.where(allowed, share, 0)
    return shares


class Words:
    """Likelihoods of words in each language, relative to the best one; -1 stands for words without a letter."""

    def __init__(self, blocks: list, languages: int) -> None:
        self.blocks, self.languages = blocks, languages
        self.most = STORE_WORDS * BLOCK // max(BLOCK, languages)
        self._reset()

    def _reset(self) -> None:
        self.row: dict[bytes, int] = {}
        self.like = np.zeros((0, self.languages))

    def _scored(self, block, slots: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Log-likelihoods of some words in the languages of a block."""
        table = block.value
        if len(self.blocks) > 1:
            vars(block).pop("_value", None)  # one block at a time in memory; it is read again from the executor's disk
        return np.stack([np.bincount(owner, table[slots, k], n) for k in range(table.shape[1])], 1)

    def rows(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The row in ``like`` and the text of each word that has a letter."""
        if len(self.row) >= self.most:
            self._reset()
        fresh = list({w for words in texts for w in words if w not in self.row})
        real = [w for w in fresh if lettered(w)]
        if real:
            ends = np.cumsum([len(w) for w in real])
            starts = np.concatenate([[0], ends[:-1]])
            slots, owner = _grams(np.frombuffer(b"".join(real), np.uint8), starts, ends)
            scores = np.concatenate([self._scored(block, slots, owner, len(real)) for block in self.blocks], 1)
            self.row.update(zip(real, range(len(self.like), len(self.like) + len(real)), strict=True))
            self.like = np.concatenate([self.like, np.exp(np.maximum(scores - scores.max(1, keepdims=True), FLOOR))])
        self.row.update(dict.fromkeys(set(fresh) - set(real), -1))
        size = [len(x) for x in texts]
        at = np.fromiter(map(self.row.__getitem__, chain.from_iterable(texts)), np.int64, sum(size))
        of = np.repeat(np.arange(len(texts)), size)
        if any(len(w) > STORE_BYTES for w in fresh):
            for w in fresh:
                if len(w) > STORE_BYTES:
                    del self.row[w]
        return at[at >= 0], of[at >= 0]


def lettered(word: bytes) -> bool:
    """The word holds a letter of some script, not only signs beyond ASCII."""
    return any(0x61 <= b <= 0x7A for b in word[:4]) or any(c.isalpha() for c in word.decode("utf-8", "ignore"))


def predict(docs: DataFrame, langs: list[str], tables: Iterator[np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score and languages (lang and share, the largest first) of every row. The model is sent out in blocks of ``SLOTS`` numbers for each of ``BLOCK`` languages."""
    blocks = [docs.sparkSession.sparkContext.broadcast(t) for t in tables]
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Words(blocks, len(langs))
        for batch in batches:
            for part, texts in pieces(batch, most=_PIECE * BLOCK // max(BLOCK, len(langs))):
                n = len(texts)
                data, offsets = utf8(texts)
                raw, at = data.tobytes().translate(_SPLIT), offsets.tolist()
                shares = np.zeros((n, len(langs)))
                if langs:
                    rows, of = store.rows([raw[a:b].split() for a, b in zip(at, at[1:], strict=False)])
                    if len(rows):
                        pairs, count = np.unique(of * len(store.like) + rows, return_counts=True)
                        shares = mixture(store.like[pairs % len(store.like)], count.astype(float), pairs // len(store.like), n)
                sets = [sorted(((langs[k], min(1.0, float(x[k]))) for k in np.flatnonzero(x)), key=lambda y: (-y[1], y[0])) for x in shares]
                named = [x[0] if x else ("und", 0.0) for x in sets]
                columns = [pa.array([x for x, _ in named], pa.string()), pa.array([x for _, x in named], pa.float64()), pa.array([[{"lang": a, "share": b} for a, b in x] for x in sets], kind)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang string, share double>>")


def split_of(doc_id: str = "doc_id") -> F.Column:
    """crc32 of doc_id as text, modulo 4; rows with 2 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, and predict every row."""
    langs, tables = learn(docs.where(F.coalesce(split_of() != 2, F.lit(True))))
    out = predict(docs, langs, tables)
    return out.select("doc_id", F.coalesce(split_of() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")
