"""Encoding of whole texts, a piece of many texts at a time, with a store of encoded chunks.

A chunk is a run of ASCII white space with the run of other bytes behind it. The pre-tokenisation patterns of
both public vocabularies never join bytes across a chunk's start, so a text's ids are those of its chunks in
order. Texts for which that does not hold (with white space beyond ASCII, or with what may be the string of a
special token) and chunks too long for the store are encoded directly, whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd

from ._text import NON_SPACE, prefix_hash, span_hash

#: Chunks that a store keeps; beyond it the store starts anew, which changes speed only.
STORE_CHUNKS = 1 << 20
#: Bytes of the longest chunk that is kept.
STORE_BYTES = 64
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def awkward(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: it holds white space or separators beyond the six ASCII ones, or '<|'."""
    n = len(data)
    odd = (data >= 0x1C) & (data <= 0x1F)
    if n > 1:
        a, b = data[:-1], data[1:]
        odd[:-1] |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0x3C) & (b == 0x7C)
    if n > 2:
        lead = np.flatnonzero((data[:-2] == 0xE1) | (data[:-2] == 0xE2) | (data[:-2] == 0xE3))
        a, b, c = data[lead], data[lead + 1], data[lead + 2]
        hit = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        odd[lead[hit]] = True
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
    return out


class ChunkEncoder:
    """encode_many gives all ids of some texts, and the number of each text's; fold: texts that differ in the case of A-Z only have the same ids."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, Sequence[int]]], fold: bool) -> None:
        self.encode_many, self.fold = encode_many, fold
        self.forget()

    def forget(self) -> None:
        """Start the store anew."""
        self.index: dict[bytes, int] = {}
        self.at, self.count, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.pool, self.filled = np.zeros(1 << 18, np.uint32), 0

    def _add(self, texts: list[str]) -> int:
        """Encode the texts and append them; the slot of the first."""
        ids, count = self.encode_many(texts)
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.used + len(count) > len(self.at):
            self.at, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.count))
        self.pool[self.filled : self.filled + len(ids)] = ids
        first, n = self.used, np.array(count, np.int64)
        self.count[first : first + len(n)] = n
        self.at[first : first + len(n)] = self.filled + np.cumsum(n) - n
        self.filled += len(ids)
        self.used += len(n)
        return first

    def _alike(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunks: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Of each chunk: its bytes are those of the other one."""
        n = (ends - starts)[chunks]
        out = n == (ends - starts)[others]
        at = np.flatnonzero(out & (chunks != others))
        n, low = n[at], (_LOWER[data] if self.fold else data)
        firsts = np.cumsum(n) - n
        within = np.arange(int(n.sum()), dtype=np.int32) - np.repeat(firsts.astype(np.int32), n)
        differ = low[np.repeat(starts[chunks[at]].astype(np.int32), n) + within] != low[np.repeat(starts[others[at]].astype(np.int32), n) + within]
        out[at[np.searchsorted(firsts, np.flatnonzero(differ), "right") - 1]] = False
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of each text's."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(texts, np.int64)
        if len(self.index) > STORE_CHUNKS:
            self.forget()
        full = np.diff(offsets) > 0
        first = np.zeros(len(data), bool)
        first[offsets[:-1][full]] = True
        space = ~NON_SPACE[data]
        starts = np.flatnonzero(first | space & np.concatenate([[True], ~space[:-1]]))
        of = np.searchsorted(offsets, starts, "right") - 1
        odd = awkward(data, offsets)
        if odd.any():
            keep = ~odd[of] | first[starts]
            starts, of = starts[keep], of[keep]
        ends = np.append(starts[1:], len(data))
        direct = odd[of] | (ends - starts > STORE_BYTES) | (ends >= 1 << 31)
        hashes = span_hash(prefix_hash(data, self.fold), starts, ends)
        where = np.flatnonzero(~direct)
        codes, keys = pd.factorize(hashes[where])
        sample = np.empty(len(keys), np.int64)
        sample[codes[::-1]] = where[::-1]
        if len(where):  # bytes decide; a chunk that only shares the hash is encoded by itself
            alike = self._alike(data, starts, ends, where, sample[codes])
            if not alike.all():
                direct[where[~alike]] = True
                where, codes = where[alike], codes[alike]
        raw, get = data.tobytes(), self.index.get
        known = np.empty(len(keys), np.int64)
        new: list[str] = []
        for k, (a, b) in enumerate(zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)):
            chunk = raw[a:b]
            key = chunk.lower() if self.fold else chunk
            found = get(key)
            if found is None:
                found = self.index[key] = self.used + len(new)
                new.append(chunk.decode())
            known[k] = found
        if new:
            self._add(new)
        slots = np.empty(len(starts), np.int64)
        slots[where] = known[codes]
        mark = self.used, self.filled
        alone = np.flatnonzero(direct)
        if len(alone):
            slots[alone] = self._add([raw[a:b].decode() for a, b in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)]) + np.arange(len(alone))
        n = self.count[slots]
        before = np.cumsum(n) - n
        ids = self.pool[np.repeat(self.at[slots] - before, n) + np.arange(int(n.sum()))]
        self.used, self.filled = mark
        return ids, np.bincount(of, n, texts).astype(np.int64)
