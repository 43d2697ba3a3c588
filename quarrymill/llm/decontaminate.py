"""Operator 8: benchmark decontamination by latent semantic retrieval.

* The corpus is cut into passages of ``PASSAGE`` words. Words are hashed to ``SLOTS`` slots; the passages that hold a slot give its inverse
  document frequency, so long documents count as many passages. Slots that more than ``STOP`` of the passages hold weigh nothing. Items
  for which nothing is left that way are looked for by their words alone.
* A randomised SVD of their TF-IDF matrix A takes one pass: each task
  multiplies its rows into A'(A O) for one random matrix O; slot by slot these are summed up, and an SVD on the driver
  (``SLOTS`` by ``RANK + EXTRA`` numbers, whatever the corpus holds) gives the leading ``RANK`` latent directions and their
  singular values. Texts are folded in as usual: the TF-IDF vector is projected on the directions, each divided by its value.
* An item that stands in a text word by word is found by its hash at the places of its rarest word, and needs no cosine.
* Items of about the same length are looked for with windows of that length, a quarter of it apart. Windows whose latent
  cosine with an item is ``COSINE`` or more, and those that overlap them, are candidates. Words that no item holds
  are left out of a window's vector.
* Most windows need no cosine, as they could not be confirmed: of an item's n words at most n - m can be missing from a match
  of m = SHARE n words, so any match holds r of the item's rarest n - m + r words. An inverted list of these words leaves out
  windows that, widened, hold fewer. This bound is exact; it saves time and changes no result.
* A candidate is confirmed on words: the longest common subsequence of the item and the window, widened by half its length on
  both sides, holds ``SHARE`` of the item's words, and ``ANSWER`` of the words of its answer (what follows the last
  question mark that has a word behind it, else its last sentence), which tells a paraphrase from text that only shares the topic. Before the
  subsequence is computed, its upper bound is, the words that both have.

Words are runs of digits, letters and characters beyond ASCII, in lower case. Items of less than ``LEAST_WORDS`` words
are matched only as a whole, word by word, and looked for as such at every word. Null text counts as empty and matches nothing; items without words
match nothing. Repeated rows are searched each by itself. Items are sent out in blocks of ``ITEMS_AT_ONCE``; a task holds one block
at a time and searches all of them in its one pass over the documents. Of windows that an item fits equally well the first
counts. An empty table on either side gives an empty result; other columns of the documents are dropped, and a text of any length is searched whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import _BASE, ALNUM, mix, pieces, powers, span_hash, words_of

SLOTS = 1 << 13
RANK = 48
EXTRA = 8
#: Share of the passages that a stop word's slot is in.
STOP = 0.1
PASSAGE = 64
COSINE = 0.25
SHARE = 0.6
ANSWER = 0.5
LEAST_WORDS = 8
#: Words of a window at most; a longer item is looked for by its parts of this length.
LONGEST = 96
#: Items that are sent to the executors at a time, and characters of them (one item at least).
ITEMS_AT_ONCE = 5000
ITEMS_CHARS = 4 << 20
#: The r of the bound by rare words, as a share of an item's words. It trades the frequency of words looked for against the number of windows and changes no result.
RARE = 0.3
#: Words of a block; windows are whole blocks.
STEP = 4
#: Texts worked on at a time, in bytes.
_PIECE = 1 << 19
#: Rows that are summed at a time.
_RUNS = 1 << 16


def _words(texts: pa.Array) -> list[list[bytes]]:
    return list(words_of(pc.utf8_lower(texts), ALNUM))


def _slots(words: Iterable[bytes], n: int) -> np.ndarray:
    return (np.fromiter(map(zlib.crc32, words), np.uint32, n) & np.uint32(SLOTS - 1)).astype(np.int64)


def _slotted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text index of each word."""
    words = _words(texts)
    size = [len(x) for x in words]
    return _slots(chain.from_iterable(words), sum(size)), np.repeat(np.arange(len(size)), size)


def _passages(of: np.ndarray) -> np.ndarray:
    """Number of each word's passage; passages end with their text."""
    count = np.bincount(of)
    place = np.arange(len(of)) - (np.cumsum(count) - count)[of]
    return np.cumsum((place % PASSAGE) == 0) - 1


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Passages with each slot, and all passages; slot SLOTS stands for the latter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            for _, texts in pieces(batch):
                slots, of = _slotted(texts)
                if not len(slots):
                    continue
                passage = _passages(of)
                order = np.argsort(slots.astype(np.int16), kind="stable")
                slot, passage = slots[order], passage[order]
                new = (np.diff(slot, prepend=-1) != 0) | (np.diff(passage, prepend=-1) != 0)
                count[:SLOTS] += np.bincount(slot[new], minlength=SLOTS)
                count[SLOTS] += int(passage.max()) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS + 1)), pa.array(count)], names=["slot", "n"])

    rows = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # SLOTS + 1 rows
    count = np.zeros(SLOTS + 1, np.int64)
    for r in rows:
        count[r.slot] = r.n
    return count[:SLOTS], int(count[SLOTS])


def _idf(count: np.ndarray, n: int) -> np.ndarray:
    """Weights of the slots; 0 for stop words."""
    return np.where(count > STOP * n, 0, np.log((n + 1) / (count + 1))).astype(np.float32)


def _summed(rows: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows[at] over the runs that start at ``first``; runs of about the same length together, filled up with a row of zeros."""
    size = np.diff(np.append(first, len(at)))
    wide = np.ceil(np.log2(size)).astype(np.int64)
    rows = np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)])
    out = np.empty((len(first), rows.shape[1]), rows.dtype)
    for k in np.unique(wide):
        own = np.flatnonzero(wide == k)
        for part in np.split(own, range(max(1, _RUNS >> k), len(own), max(1, _RUNS >> k))):
            place = np.arange(1 << k)
            taken = np.where(place < size[part, None], at[np.minimum(first[part, None] + place, len(at) - 1)], len(rows) - 1)
            out[part] = rows[taken].sum(1)
    return out


def latent_space(docs: DataFrame, idf: np.ndarray) -> np.ndarray:
    """SLOTS by RANK: what a word adds to the latent vector of its passage."""
    spark = docs.sparkSession
    wide = RANK + EXTRA
    weights = spark.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = weights.value
        mixed = idf[:, None] * np.random.default_rng(7).standard_normal((SLOTS, wide), np.float32)
        total = np.zeros((SLOTS, wide))
        for batch in batches:
            for _, texts in pieces(batch, most=_PIECE):
                slots, of = _slotted(texts)
                if not len(slots):
                    continue
                passage = _passages(of)
                weighed = idf[slots] > 0
                slots, passage = slots[weighed], passage[weighed]
                if not len(slots):
                    continue
                first = np.flatnonzero(np.diff(passage, prepend=-1))
                passage = np.cumsum(np.diff(passage, prepend=passage[0]) > 0)
                norm = np.add.reduceat(idf[slots] ** 2, first)
                y = _summed(mixed, slots, first) / norm[:, None]
                order = np.argsort(slots.astype(np.int16), kind="stable")
                cuts = np.flatnonzero(np.diff(slots[order], prepend=-1))
                total[slots[order[cuts]]] += _summed(y, passage[order], cuts)
        total *= idf[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS)), pa.ListArray.from_arrays(pa.array(np.arange(SLOTS + 1) * wide, pa.int32()), pa.array(total.reshape(-1)))], names=["slot", "y"])

    parts = docs.select("text").mapInArrow(run, "slot long, y array<double>")
    rows = parts.groupBy("slot").agg(F.array(*(F.sum(F.col("y")[k]) for k in range(wide))).alias("y")).collect()  # SLOTS rows
    y = np.zeros((SLOTS, wide))
    for r in rows:
        y[r.slot] = r.y
    left, values, _ = np.linalg.svd(y, full_matrices=False)
    real = values[:RANK] > 1e-9 * max(values[0], 1e-300)
    return (idf[:, None] * left[:, :RANK][:, real] / np.sqrt(values[:RANK][real])).astype(np.float32)


def _answer(text: str) -> str:
    """What follows the last question mark that has a word behind it, else the last sentence."""
    body = re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$", "", text)
    cut = body.rfind("?")
    if cut >= 0:
        return text[cut + 1 :]
    cut = max(body.rfind(". "), body.rfind(".\n"), body.rfind("! "), body.rfind("\n"))
    return text[cut + 1 :]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of b's places at a time."""
    masks: dict[int, int] = {}
    for i, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & masks.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-9)[:, None]


class Items:
    """A block of benchmark items, their parts and words; sent to the executors."""

    def __init__(self, rows: list[tuple[int, str]], space: np.ndarray, held: np.ndarray) -> None:
        self.ids, self.words, self.answers, texts = [], [], [], []
        #: Numbers of the items' words, from 1; 0 stands for all others.
        self.vocabulary: dict[bytes, int] = {}
        for item, text in rows:
            words, answer = (_words(pa.array([x], pa.large_string()))[0] for x in (text or "", _answer(text or "")))
            if words:
                for w in words:
                    self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
                self.ids.append(item)
                self.words.append([self.vocabulary[w] for w in words])
                self.answers.append([self.vocabulary[w] for w in answer])
                texts.append(np.array(self.words[-1]))
        slots = _slots(self.vocabulary, len(self.vocabulary))
        #: Of each number: what the word adds to a latent vector, and the documents that hold it.
        self.space = np.concatenate([np.zeros((1, space.shape[1]), np.float32), space[slots]])
        documents = np.concatenate([[0], held[slots]])
        self.short: dict[int, dict[int, list[int]]] = {}
        #: Of each item: width of its windows, what they are widened by, words of its rare ones that any match holds, and unit vectors of its parts.
        self.width, self.around, self.least = (np.ones(len(texts), np.int64) for _ in range(3))
        self.units: list[np.ndarray] = [np.zeros((0, space.shape[1]), np.float32)] * len(texts)
        #: Items of which a part has no word of any weight.
        self.blind = np.zeros(len(texts), bool)
        #: Of each item of many words: its rarest word, where that first stands, its length, and the hash of all its words.
        self.anchor, self.place, self.length, self.hash = (np.zeros(len(texts), t) for t in (np.int64, np.int64, np.int64, np.uint64))
        postings: list[tuple[np.ndarray, int]] = []
        for i, words in enumerate(texts):
            if len(words) < LEAST_WORDS:
                self.short.setdefault(len(words), {}).setdefault(int(_runs(words, len(words))[0]), []).append(i)
                continue
            rare, self.least[i] = _rare(words, documents)
            postings.append((rare, i))
            self.anchor[i], self.place[i], self.length[i] = rare[0], int(np.flatnonzero(words == rare[0])[0]), len(words)
            self.hash[i] = span_hash(_sums(words), np.array([0]), np.array([len(words)]))[0]
            size = min(len(words), LONGEST)
            self.width[i] = max(4, 4 * round(2 ** (round(2 * np.log2(size)) / 2) / 4))
            self.around[i] = self.width[i] // 2 if len(words) <= LONGEST else len(words)
            parts = np.stack([self.space[words[at : at + LONGEST]].sum(0) for at in range(0, max(1, len(words) - LONGEST // 2), LONGEST // 2)])
            self.blind[i] = not parts.any(1).all()
            self.units[i] = _unit(parts)
        word = np.concatenate([w for w, _ in postings]) if postings else np.zeros(0, np.int64)
        item = np.concatenate([np.full(len(w), i) for w, i in postings]) if postings else np.zeros(0, np.int64)
        #: Items of each word that is rare in them: item[start[k] : start[k + 1]] of word k.
        self.rare_start = np.searchsorted(np.sort(word), np.arange(len(self.vocabulary) + 2))
        self.rare_item = item[np.argsort(word, kind="stable")]
        #: Items of each word that is the rarest in them, likewise.
        long = np.flatnonzero(self.length)
        self.anchor_start = np.searchsorted(np.sort(self.anchor[long]), np.arange(len(self.vocabulary) + 2))
        self.anchor_item = long[np.argsort(self.anchor[long], kind="stable")]
        self.bags = [dict(zip(*(x.tolist() for x in np.unique(t, return_counts=True)), strict=True)) for t in texts]

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Number and text index of each word."""
        size = [len(x) for x in texts]
        return np.fromiter(map(self.vocabulary.get, chain.from_iterable(texts), repeat(0)), np.int64, sum(size)), np.repeat(np.arange(len(size)), size)

    def confirm(self, item: int, words: list[int]) -> tuple[float, float]:
        """Shares of the item's and of its answer's words in the longest common subsequence with the words."""
        own, answer = self.words[item], self.answers[item]
        share = common_subsequence(words, own) / len(own)
        if share < SHARE:
            return share, 0.0
        return share, common_subsequence(words, answer) / len(answer) if answer else 1.0


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words at each place."""
    words = words.astype(np.uint64)
    out = words[: max(0, len(words) - n + 1)]
    for k in range(1, n):
        out = mix(out) ^ words[k : len(out) + k]
    return mix(out)


def _rare(words: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, int]:
    """The item's rarest words, by the documents that hold them, and how many places of them any match holds."""
    own, count = np.unique(words, return_counts=True)
    missing = len(words) - int(np.ceil(SHARE * len(words) - 1e-9))
    order = np.argsort(documents[own], kind="stable")
    places = np.cumsum(count[order])
    k = int(np.searchsorted(places, min(len(words), missing + max(1, round(RARE * len(words))))))
    return own[order[: k + 1]], int(places[k]) - missing


def _sums(words: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the words' numbers, for ``span_hash``."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words.astype(np.uint64)) * powers(_BASE, len(words)), out=out[1:])
        return out


def _listed(start: np.ndarray, items: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and item of each pair of a word and an item in the word's list."""
    at = np.flatnonzero(np.diff(start)[words])
    head, n = start[words[at]], np.diff(start)[words[at]]
    return np.repeat(at, n), items[np.repeat(head - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


def _whole_hits(items: Items, words: np.ndarray, of: np.ndarray, first: np.ndarray, best: dict) -> None:
    """Items of many words that stand in a text word by word."""
    at, item = _listed(items.anchor_start, items.anchor_item, words)
    a = at - items.place[item]
    e = a + items.length[item]
    inside = (a >= first[of[at]]) & (e <= first[of[at] + 1])
    a, e, item = a[inside], e[inside], item[inside]
    same = span_hash(_sums(words), a, e) == items.hash[item]
    for x, y, i in zip(a[same].tolist(), e[same].tolist(), item[same].tolist(), strict=True):
        if (int(of[x]), i) not in best and items.words[i] == words[x:y].tolist():
            best[int(of[x]), i] = 1.0, 1.0, 1.0, int(x - first[of[x]])


def _short_hits(items: Items, words: np.ndarray, of: np.ndarray, first: np.ndarray, best: dict) -> None:
    """Items of few words, as a whole, wherever they stand."""
    for n, known in items.short.items():
        hashes = _runs(words, n)
        at = np.flatnonzero(np.isin(hashes, np.fromiter(known, np.uint64, len(known))) & (of[: len(hashes)] == of[n - 1 :]))
        _, seen = np.unique(np.stack([of[at].astype(np.uint64), hashes[at]]), axis=1, return_index=True)
        for p in np.sort(at[seen]).tolist():
            for i in known[int(hashes[p])]:
                if items.words[i] == words[p : p + n].tolist():
                    best[int(of[p]), i] = 1.0, 1.0, 1.0, int(p - first[of[p]])


def _rare_windows(items: Items, words: np.ndarray, of: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first block and item of the windows that hold enough of an item's rare words when widened."""
    none = np.zeros(0, np.int64)
    if not len(items.rare_item):
        return none, none, none
    place, item = _listed(items.rare_start, items.rare_item, words)
    order = np.argsort(item, kind="stable")
    item, place = item[order], place[order]
    to = np.arange(len(item)) + items.least[item] - 1
    end = np.minimum(to, max(0, len(item) - 1))
    reach = items.width[item] + 2 * items.around[item]
    ok = (to < len(item)) & (item[end] == item) & (of[place[end]] == of[place]) & (place[end] - place < reach)
    item, x, y = item[ok], place[ok], place[end[ok]]
    doc = of[x]
    x, y = x - first[doc], y - first[doc]
    blocks = items.width[item] // STEP
    step = np.maximum(1, blocks // 4)
    low = -(-np.maximum(0, y - items.width[item] - items.around[item] + 1) // (STEP * step))
    high = np.minimum((x + items.around[item]) // (STEP * step), np.maximum(0, -(-(rows[doc] - blocks) // step)))
    low = np.minimum(low, high)  # windows at a text's end are widened to the end
    n = high - low + 1
    window = np.repeat(low * step, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * np.repeat(step, n)
    most, kinds = int(rows.max(initial=0)) + 1, len(items.ids)
    found = np.unique((np.repeat(doc, n) * kinds + np.repeat(item, n)) * most + window)
    pair, window = found // most, found % most
    return pair // kinds, window, pair % kinds


def _cosines(items: Items, words: np.ndarray, a: np.ndarray, e: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Latent cosine of the words a to e with the item, or with the nearest of its parts. Words that no item holds add nothing."""
    n = e - a
    head = np.cumsum(n) - n
    at = np.repeat(a - head, n) + np.arange(int(n.sum()))
    v = _unit(np.add.reduceat(items.space[words[at]], head, 0))
    order = np.argsort(which, kind="stable")
    out = np.zeros(len(which))
    for group in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
        out[group] = 1.0 if items.blind[which[group[0]]] else (v[group] @ items.units[which[group[0]]].T).max(1)
    return out


def _beside(doc: np.ndarray, item: np.ndarray, a: np.ndarray, width: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The best cosine of each window and of those that overlap it: vectors and words need not fit best at the same step."""
    out = cosines.copy()
    for k in range(1, 5):
        both = (doc[k:] == doc[:-k]) & (item[k:] == item[:-k]) & (a[k:] - a[:-k] < width[k:])
        out[k:][both] = np.maximum(out[k:], cosines[:-k])[both]
        out[:-k][both] = np.maximum(out[:-k], cosines[k:])[both]
    return out


def _found(items: Items, texts: list[list[bytes]]) -> dict[tuple[int, int], tuple[float, float, float, int]]:
    """By text and item: cosine, share, answer, first word of the best confirmed window."""
    words, of = items.numbers(texts)
    best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    if not items.ids or not len(words):
        return best
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    rows = -(-np.diff(first) // STEP)  # blocks of STEP words of each text
    _short_hits(items, words, of, first, best)
    _whole_hits(items, words, of, first, best)
    doc, block, item = _rare_windows(items, words, of, first, rows)
    a = first[doc] + STEP * block
    e = np.minimum(a + items.width[item], first[doc + 1])
    cosines = np.concatenate([np.zeros(0), *(_cosines(items, words, a[i : i + 2048], e[i : i + 2048], item[i : i + 2048]) for i in range(0, len(doc), 2048))])
    near = np.flatnonzero(_beside(doc, item, a, items.width[item], cosines) >= COSINE)
    _confirm(items, words, first, doc[near], a[near], e[near], item[near], cosines[near], best)
    return best


def _search(docs: DataFrame, blocks: list[Items]) -> DataFrame:
    """doc_id, item_id, cosine, share, answer, first word of the confirmed windows of each row, in one pass over all blocks."""
    sent = [docs.sparkSession.sparkContext.broadcast(items) for items in blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, most=_PIECE if len(sent) == 1 else 4 * _PIECE):
                words = _words(texts)
                for block in sent:
                    items = block.value
                    best = _found(items, words)
                    if len(sent) > 1:
                        vars(block).pop("_value", None)  # one block at a time in memory; it is read again from the executor's disk
                    if best:
                        keys = list(best)
                        cos, share, answer, place = zip(*best.values(), strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array([d for d, _ in keys])), pa.array([items.ids[k] for _, k in keys], pa.int64()), pa.array(cos, pa.float64()), pa.array(share, pa.float64()), pa.array(answer, pa.float64()), pa.array(place, pa.int64())],
                            names=["doc_id", "item_id", "cosine", "share", "answer", "first_word"],
                        )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, cosine double, share double, answer double, first_word long")


def _confirm(items, words, first, doc, a, e, candidates, cosines, best) -> None:
    """Keep, of each document and item, the best window that the word checks confirm."""
    low = np.maximum(a - items.width[candidates] // 2, first[doc])
    high = np.minimum(e + items.width[candidates] // 2, first[doc + 1])
    held: dict[tuple[int, int], tuple[list[int], dict[int, int]]] = {}
    for w, (item, cosine) in enumerate(zip(candidates.tolist(), cosines.tolist(), strict=True)):
        key = int(doc[w]), item
        if key in best and best[key][1] >= 0.999:
            continue
        place = int(low[w]), int(high[w])
        if place not in held:
            if len(held) > 64:
                held.clear()
            own = words[place[0] : place[1]].tolist()
            held[place] = own, Counter(own)
        own, bag = held[place]
        n = len(items.words[item])
        if n > LONGEST:
            lo, hi = max(first[doc[w]], a[w] - n), min(first[doc[w] + 1], e[w] + n)
            own = words[lo:hi].tolist()
            bag = Counter(own)
        if sum(min(c, bag.get(x, 0)) for x, c in items.bags[item].items()) < SHARE * n - 1e-9:
            continue
        share, answer = items.confirm(item, own)
        if share >= SHARE and answer >= ANSWER and (key not in best or share > best[key][1]):
            best[key] = cosine, share, answer, int(a[w] - first[doc[w]])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, share, answer, first_word: each row's items that its text holds or paraphrases."""
    count, n = frequencies(docs)
    space = latent_space(docs, _idf(count, n))
    return _search(docs, [Items(rows, space, count) for rows in _blocks(benchmark)])


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in bounded blocks, at least one; the driver holds a partition of the benchmark at a time."""
    rows: list[tuple[int, str]] = []
    size = blocks = 0
    for r in benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        if rows and (len(rows) >= ITEMS_AT_ONCE or size + len(r.text) > ITEMS_CHARS):
            yield rows
            rows, size, blocks = [], 0, blocks + 1
        rows.append((r.item_id, r.text))
        size += len(r.text)
    if rows or not blocks:
        yield rows


def flagged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, items (array of item_id), share (the best) of the documents that hold an item."""
    hits = contaminated(docs, benchmark)
    return hits.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("share").alias("share"))
