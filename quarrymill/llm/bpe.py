"""Operator 3: byte-pair encoding and decoding.

Encoding does not replay merges. An Aho-Corasick automaton over the reversed vocabulary lists, for each
position of a word, the tokens that start there, longest first. The encoder takes the longest token that is
compatible with the one before it and steps back where none is. Two tokens are compatible if no merge would
ever join material across their border; a sequence of tokens is the result of the merges if and only if each
neighbouring pair is compatible, so the first complete sequence found is the exact result, and each position
is given up at most once, which keeps the time linear in the word's length. Decoding takes token texts from
one byte string through a table of offsets.

Classes, cases and normal forms of characters are this Python's, which may know another version of Unicode than the tokenizers library
does. So a character beyond ASCII is held against the library when a worker first meets it, inside and beside words, and a text with
one that both treat differently is encoded by the library.

Null text counts as empty: no token, empty decoded text. Repeated rows are encoded alike, row by row; other
columns of the input pass through ``encode`` untouched, and columns of its own names are replaced. An empty table gives an empty
result; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import pieces, release, utf8
from .chunks import ChunkEncoder

#: Words whose ids a worker keeps; beyond it the store starts anew, which changes speed only.
CACHE_WORDS = 1 << 16
#: The symbol that ends a word is told apart from the same symbol inside a word by this shift.
_END = 0x10000
#: The pre-tokenisation patterns of the two public vocabularies (white space written out as a property).
SPLIT_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
SPLIT_BYTES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class BacktrackingBPE:
    """An exact encoder and decoder for a vocabulary file of the tokenizers library with byte-level BPE."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.lower = bool(spec.get("normalizer"))
        self.spaced = spec.get("decoder") is None
        self._split = regex.compile(SPLIT_WORDS if self.suffix else SPLIT_BYTES)
        self._bytes = {b: c for b, c in enumerate(byte_symbols())}
        vocab: dict[str, int] = model["vocab"]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.symbols = {i: self._marked(t) for t, i in vocab.items()}
        self.pair: dict[int, int] = {}
        self.rank = dict.fromkeys(self.symbols, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ids = vocab[left], vocab[right]
            self.pair[ids[0] << 32 | ids[1]] = rank
            made = vocab[(left.removesuffix(self.suffix) if self.suffix else left) + right]
            if made not in self.parts:
                self.parts[made], self.rank[made] = ids, rank
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._cache: dict[str, bytes] = {}
        self._path, self._agreed = path, {chr(i): True for i in range(128)}
        self._reversed = ahocorasick.Automaton()
        for i, s in self.symbols.items():
            if (len(s) == 1 or i in self.parts) and self._reachable(i):
                self._reversed.add_word(s[::-1], i)
        self._reversed.make_automaton()
        own = {s: i for i, s in self.symbols.items() if s[::-1] in self._reversed}
        #: Of each token: its symbols, and the longest token that is a proper prefix of it.
        self._length = {i: len(s) for s, i in own.items()}
        self._shorter = {i: next((own[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in own), -1) for s, i in own.items()}
        self._chunks = ChunkEncoder(self._many, bool(self.suffix))
        texts = [b""] * self.size
        for t, i in chain(vocab.items(), self.special.items()):
            texts[i] = t.encode() if self.spaced or i not in self.symbols else self._raw(t)
        #: Token i is blob[offsets[i]:offsets[i + 1]].
        self.blob, self.offsets = b"".join(texts), np.cumsum([0, *map(len, texts)])

    def _marked(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token.removesuffix(self.suffix)
            return token[:-1] + chr(ord(token[-1]) + _END)
        return token

    def _raw(self, token: str) -> bytes:
        back = self.__dict__.setdefault("_back", {c: b for b, c in self._bytes.items()})
        return bytes(back[c] for c in token)

    def _edge(self, token: int, side: int, memo: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of the token while it forms, each with the rank that consumes it."""
        if token not in memo:
            out, at, until = [], token, 1 << 60
            while True:
                out.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.rank[at], self.parts[at][side]
            memo[token] = out
        return memo[token]

    def fits(self, left: int, right: int) -> bool:
        """No merge ever crosses the border between the two tokens. Of equal ranks, the one on the left merges first."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            known, rank, pair = True, self.rank, self.pair.get
            inner = self._edge(right, 0, self._left)
            for a, a_until in self._edge(left, 1, self._right):
                for b, b_until in inner:
                    r = pair(a << 32 | b)
                    if r is not None and rank[a] < r < a_until and rank[b] < r <= b_until:
                        known = False
                        break
                if not known:
                    break
            if len(self._fits) > 200_000:
                self._fits.clear()
            self._fits[key] = known
        return known

    def _reachable(self, token: int) -> bool:
        """Merging the token's own symbols ends in the token."""
        if token not in self._whole:
            if token not in self.parts:
                self._whole[token] = True
            else:
                a, b = self.parts[token]
                r = self.rank[token]
                early = any(
                    self.rank[x] < m < min(x_until, r) and self.rank[y] < m <= min(y_until, r)
                    for x, x_until in self._edge(a, 1, self._right)
                    for y, y_until in self._edge(b, 0, self._left)
                    if (m := self.pair.get(x << 32 | y)) is not None and (x, y) != (a, b)
                )
                self._whole[token] = self._reachable(a) and self._reachable(b) and not early
        return self._whole[token]

    def symbols_to_ids(self, s: str) -> list[int]:
        """Exact BPE of one pre-token, given as symbols."""
        n = len(s)
        longest = dict(reversed(list(self._reversed.iter(s[::-1]))))  # of the matches at a place, the first is the longest
        if len(longest) < n:  # symbols that the vocabulary lacks are left out, as the library does without an unknown token
            kept = "".join(c for i, c in enumerate(s) if n - 1 - i in longest)
            return self.symbols_to_ids(kept) if kept else []
        length, shorter, fits = self._length, self._shorter, self._fits
        dead: set[int] = set()
        out: list[int] = []
        at, last, token = 0, -1, longest[n - 1]
        while True:
            while token >= 0:
                to = at + length[token]
                if to not in dead and (last < 0 or (known if (known := fits.get(last << 32 | token)) is not None else self.fits(last, token))):
                    break
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                last = out[-1] if out else -1
                at -= length[token]
                token = shorter[token]
                continue
            out.append(token)
            if to == n:
                return out
            at, last, token = to, token, longest[n - 1 - to]

    def _word(self, word: str) -> bytes:
        symbols = "".join(map(self._bytes.__getitem__, word.encode()))
        if self.suffix:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + _END)
        ids = array("I", self.symbols_to_ids(symbols)).tobytes()
        if len(self._cache) >= CACHE_WORDS:
            self._cache.clear()
        self._cache[word] = ids
        return ids

    def normalized(self, text: str) -> str:
        if self.lower:
            text = unicodedata.normalize("NFC", text)  # white space needs no change, as the pattern drops it
            text = text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()
        return text

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        words = self._split.findall(self.normalized(text))
        try:
            return b"".join(map(self._cache.__getitem__, words))
        except KeyError:
            get, word = self._cache.get, self._word
            return b"".join([got if (got := get(w)) is not None else word(w) for w in words])

    def _library(self, specials: bool = True):  # noqa: ANN202
        """The tokenizers library with the same file."""
        held = self.__dict__.setdefault("_libraries", {})
        if specials not in held:
            from tokenizers import Tokenizer

            library = held[specials] = Tokenizer.from_file(self._path)
            library.no_truncation()
            library.no_padding()
            library.encode_special_tokens = not specials
        return held[specials]

    def _known(self, text: str) -> bool:
        """This class normalises and splits every character of the text as the library does."""
        agreed = self._agreed
        new = [c for c in set(text) if c not in agreed]
        for c in new:
            probe, library = f"a{c}a 1{c}1 !{c}! {c}{c} a{c}!{c}1{c}a", self._library()
            want = library.normalizer.normalize_str(probe) if library.normalizer else probe
            words = ["".join(map(self._bytes.__getitem__, w.encode())) for w in self._split.findall(self.normalized(probe))]
            agreed[c] = words == [w for w, _ in library.pre_tokenizer.pre_tokenize_str(want)]
        return all(map(agreed.__getitem__, set(text)))

    def encode(self, text: str, specials: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. specials: the strings of special tokens become their ids."""
        if not text.isascii() and not self._known(text):
            return np.array(self._library(specials).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not specials or not self._special or "<|" not in text:
            return self._plain(text)
        parts = self._special.split(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if i % 2 else self._plain(x) for i, x in enumerate(parts))

    def _many(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        held = [self.encode(x) for x in texts]
        return np.frombuffer(b"".join(held), "<u4"), [len(x) // 4 for x in held]

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts, and the number of each text's."""
        return self._chunks.encode(data, offsets)

    def forget(self) -> None:
        """Drop stored words and chunks, so a worker that waits for its next task is small."""
        self._chunks.forget()
        self._cache.clear()
        release()

    def decode(self, ids: np.ndarray) -> bytes:
        """Token texts through the offset table; with a blank between them where the vocabulary has no decoder."""
        table = self.__dict__.get("_table")
        if table is None:
            o = self.offsets.tolist()
            table = self._table = [self.blob[a:b] for a, b in zip(o, o[1:], strict=False)]
        out = (b" " if self.spaced else b"").join(map(table.__getitem__, ids.tolist()))
        return out if self.spaced else out.decode("utf-8", "replace").encode()


_loaded: dict[str, BacktrackingBPE] = {}


def load(path: str) -> BacktrackingBPE:
    """One encoder for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = BacktrackingBPE(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with ids (array of int) and n_tokens, and decoded_text on request; narrow, without a shuffle."""
    own = ["ids", "n_tokens", *["decoded_text"] * decoded]
    base = docs.drop(*own)
    kinds = {"ids": "array<int>", "n_tokens": "long", "decoded_text": "string"}
    schema = T.StructType([*base.schema.fields, *(T.StructField(n, T._parse_datatype_string(kinds[n])) for n in own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part, texts in pieces(batch, text):
                ids, counts = bpe.encode_all(*utf8(texts))
                ends = np.concatenate([[0], np.cumsum(counts)])
                more = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(counts, pa.int64())]
                if decoded:
                    more.append(pa.array([bpe.decode(ids[i:j]).decode() for i, j in zip(ends, ends[1:], strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *own])
        bpe.forget()

    return base.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: ``encode`` and ``decode`` without keeping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part, texts in pieces(batch):
                ids, counts = bpe.encode_all(*utf8(texts))
                ends = np.cumsum(counts).tolist()
                own, back = [], []
                for i, j in zip([0, *ends], ends, strict=False):
                    own.append(hashlib.sha256(ids[i:j]).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(ids[i:j])).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
