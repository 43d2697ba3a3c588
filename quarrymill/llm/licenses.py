"""Operator 5: scans for licence text.

The words of licence templates form a generalised suffix automaton, one state path for all of them. A text's words
stream through it; the matching statistics say, for each word, how many words up to it occur in a row in some
template. A match of ``LEAST`` words or more (of two fifths of a template's words, four at least, if that is fewer) opens a chain: the template is laid
over the text where the match stands, and whatever agrees there for ``JOIN`` words or more (a sixth of a short template's, two at least) joins it, so an edit costs its
neighbours only. Matches of one template that stand close together cover a span, and a template whose chained matches cover enough
of it labels the text. Beside them, three fixed phrases are reported wherever they stand.

Templates are whole texts of short licences, notices of long ones, and one-line notices; ``templates_of`` reads more from
any folder of licence files.

Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII. Null text counts as empty: no words,
no labels, score 0. Repeated rows are scanned alike; only doc_id and text are read, other columns are dropped. An empty table gives an
empty result, and a text of any length is scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import ALNUM, pieces, words_of
from .license_texts import TEXTS

#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates: one-line notices, and the texts of ``license_texts``.
TEMPLATES = {
    "mit": ["released under the mit license", "licensed under the mit license"],
    "apache-2.0": ["licensed under the apache license version 2 0"],
    "gpl": ["this work is licensed under the gnu general public license version 3"],
    "bsd": ["licensed under the bsd license"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "reserved": ["copyright all rights reserved"],
}
for _label, _texts in TEXTS.items():
    TEMPLATES[_label] = [*TEMPLATES.get(_label, []), *_texts]
#: Words of the shortest match that opens a chain, and of those that join it; short templates need fewer.
LEAST = 10
JOIN = 4
#: Share of a template that its chained matches must cover.
COVER = 0.8
#: Words between two matches of a chain, at most.
GAP = 12


class SuffixAutomaton:
    """All substrings of several token sequences. Each state knows its longest string and where one of them ends."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]

    def add(self, sequence: list[int], name: int) -> None:
        """One more sequence; every one starts anew from the root."""
        last = 0
        for at, token in enumerate(sequence):
            last = self._extend(last, token)
            self.ends[last].append((name, at + 1))

    def _state(self, length: int, like: int | None = None) -> int:
        self.length.append(length)
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, parent: int, state: int, token: int) -> int:
        copy = self._state(self.length[parent] + 1, state)
        self.link[state] = copy
        while parent >= 0 and self.next[parent].get(token) == state:
            self.next[parent][token] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if (known := self.next[last].get(token)) is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, token)
        new = self._state(self.length[last] + 1)
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at >= 0:
            known = self.next[at][token]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(at, known, token)
        return new

    def finish(self) -> None:
        """Hand the ends of each state on to the states of its suffixes."""
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] += self.ends[s]
        self.ends = [sorted(set(x)) for x in self.ends]

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """Of each token: the state and length of the longest match that ends at it."""
        out, state, length = [], 0, 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(token, 0)
            length = length + 1 if state else 0
            out.append((state, length))
        return out


def least_of(size: int) -> int:
    """Words of the shortest match that opens a chain of a template of so many words."""
    return min(LEAST, size, max(4, -(-2 * size // 5)))


def join_of(size: int) -> int:
    """Words of the shortest match that joins a chain."""
    return min(JOIN, max(2, size // 6))


def agreeing(tokens: np.ndarray, template: np.ndarray, place: int) -> list[tuple[int, int, int]]:
    """first and end in the text, first in the template of the runs of ``join_of`` equal words or more with the template's first word at the place."""
    low, high = max(0, place), min(len(tokens), place + len(template))
    same = tokens[low:high] == template[low - place : high - place]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    return [(low + a, low + b, low + a - place) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= join_of(len(template))]


class Scanner:
    """Vocabulary, phrases and automaton, built once for each worker."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]) -> None:
        words = sorted({w for t in [*phrases, *(x for v in templates.values() for x in v)] for w in t.split()})
        of = {w: i + 1 for i, w in enumerate(words)}
        self.vocabulary = {w.encode(): i for w, i in of.items()}
        self.phrases = [([of[w] for w in p.split()], label) for p, label in phrases.items()]
        self.automaton, self.labels, self.sequences, self.least = SuffixAutomaton(), [], [], []
        for label, texts in templates.items():
            for t in texts:
                tokens = [of[w] for w in t.split()]
                self.automaton.add(tokens, len(self.labels))
                self.labels.append(label)
                self.sequences.append(np.array(tokens))
                self.least.append(least_of(len(tokens)))
        self.automaton.finish()
        self.shortest = min([LEAST, *self.least])

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary id (0 for words that no template holds) and text index of each word."""
        words = list(words_of(texts, ALNUM))
        size = [len(x) for x in words]
        return np.fromiter(map(self.vocabulary.get, chain.from_iterable(words), repeat(0)), np.int64, sum(size)), np.repeat(np.arange(len(size)), size)

    def spans(self, tokens: np.ndarray) -> list[tuple[str, int, int, float]]:
        """Covered spans of one text: label, first word, end, share of the template that is covered."""
        hit = tokens != 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        opened: dict[int, set[int]] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            stats = self.automaton.statistics(tokens[a:b].tolist())
            for i, (state, length) in enumerate(stats):
                while length >= self.shortest:  # the longest match, and the shorter ones that other templates have here
                    for name, end in self.automaton.ends[state]:
                        if length >= self.least[name]:
                            opened.setdefault(name, set()).add(a + i + 1 - end)
                    state = self.automaton.link[state]
                    length = self.automaton.length[state]
        out = []
        for name, places in opened.items():
            size = len(self.sequences[name])
            runs = sorted(m for place in places for m in agreeing(tokens, self.sequences[name], place))
            out += [(self.labels[name], first, end, n / size) for first, end, n in chains(runs, COVER * size)]
        return sorted(out)


def chains(runs: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
    """first, end, words of the chains of runs (first, end, first in the template) that cover so many words.

    A run follows one that begins before it in text and template and ends ``GAP`` words before it at most; where both overlap, the words count once. Of chains that overlap in the text
    the one that covers most stays, of equals the first.
    """
    longest = max((y - x for x, y, _ in runs), default=0)
    best: list[tuple[int, int]] = []  # words up to this run, and the first word of its chain
    for i, (x, y, at) in enumerate(runs):
        most, start = y - x, x
        for j in range(i - 1, -1, -1):
            u, v, to = runs[j]
            if x - u > GAP + longest:
                break
            if u >= x or to >= at or x - v > GAP:
                continue
            new = y - x - max(0, v - x, to + v - u - at)
            if new > 0 and (best[j][0] + new, -best[j][1]) > (most, -start):
                most, start = best[j][0] + new, best[j][1]
        best.append((most, start))
    out: list[tuple[int, int, int]] = []
    for n, first, end in sorted(((n, first, runs[i][1]) for i, (n, first) in enumerate(best) if n >= least), key=lambda c: (-c[0], c[1], c[2])):
        if all(end <= f or first >= e for f, e, _ in out):
            out.append((first, end, n))
    return out


def templates_of(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Templates out of a folder of licence files, each labelled by its file's name; a bounded number of files that the caller chooses."""
    files = spark.read.option("wholetext", True).text(folder).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), "value").collect()
    return {r.name.lower(): [" ".join(w.decode() for w in next(words_of(pa.array([r.value], pa.large_string()), ALNUM)))] for r in files if r.value.strip()}


_scanners: dict[str, Scanner] = {}


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the covered spans of every row.

    score: the best share of a template that a span covers, 1 for a base phrase. Narrow, without a shuffle.
    """
    templates = TEMPLATES if templates is None else templates
    key = repr(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanners.setdefault(key, None) or Scanner(templates, PHRASES)
        _scanners[key] = scanner
        for batch in batches:
            for part, texts in pieces(batch):
                (tokens, of), n = scanner.tokens(texts), len(texts)
                n_words = np.bincount(of, minlength=n)
                firsts = np.cumsum(n_words) - n_words
                base: list[tuple[np.ndarray, str]] = []
                for phrase, label in scanner.phrases:
                    k = len(phrase)
                    if len(tokens) >= k:
                        same = of[: len(of) - k + 1] == of[k - 1 :]
                        for j, word in enumerate(phrase):
                            same &= tokens[j : len(tokens) - k + 1 + j] == word
                        base.append((np.flatnonzero(same), label))
                rows: dict[str, list] = {x: [] for x in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
                places = np.concatenate([x for x, _ in base]) if base else np.zeros(0, np.int64)
                kinds = np.concatenate([np.full(len(x), i) for i, (x, _) in enumerate(base)]) if base else places
                home = of[places] if len(places) else places
                order = np.argsort(home, kind="stable")
                places, kinds, cuts = places[order], kinds[order], np.searchsorted(home[order], np.arange(n + 1))
                for i in range(n):
                    own, kind = places[cuts[i] : cuts[i + 1]] - firsts[i], kinds[cuts[i] : cuts[i + 1]]
                    spans = scanner.spans(tokens[firsts[i] : firsts[i] + n_words[i]])
                    named = {base[k][1] for k in kind.tolist()}
                    rows["n_base"].append(len(own))
                    rows["first_word"].append(int(own.min()) if len(own) else None)
                    rows["last_word"].append(int(own.max()) if len(own) else None)
                    rows["base_labels"].append(",".join(sorted(named)))
                    rows["labels"].append(",".join(sorted(named | {s[0] for s in spans})))
                    rows["score"].append(max([1.0 if len(own) else 0.0, *(s[3] for s in spans)]))
                    rows["spans"].append([{"label": s[0], "first": s[1], "end": s[2], "cover": s[3]} for s in spans])
                span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))
                kinds_of = {"n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": span}
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), *(pa.array(rows[c], k) for c, k in kinds_of.items())], names=["doc_id", "n_words", *kinds_of])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first long, end long, cover double>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
