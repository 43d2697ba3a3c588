"""Vectorised text helpers for the Arrow operators: bytes, words and 64-bit hashes with numpy."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text is worked on alone.
PIECE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ``[^\x20\x09-\x0D]``: every byte that is no ASCII white space.
NON_SPACE = ~_SPACE
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lower-cased: digits, letters, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Of each table: words as they are compared, everything else a blank.
_SPLIT = {t.tobytes(): bytes((b + 32 if 0x41 <= b <= 0x5A else b) if t[b] else 0x20 for b in range(256)) for t in (NON_SPACE, ALNUM)}
#: Words that a worker keeps the hashes of, and the bytes of the longest that is kept.
STORE_WORDS = 1 << 17
STORE_BYTES = 64

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that scatters its input (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_FOLDED = _BYTES.copy()
_FOLDED[0x41:0x5B] = _BYTES[0x61:0x7B]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, PIECE_BYTES + 1), base, _U)
        p[0] = 1
        _powers[base] = np.cumprod(p)
    return _powers[base][:n]


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_string array, and its n + 1 offsets into them."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batch with about ``most`` bytes of text each, so temporary arrays stay bounded."""
    texts = text_array(batch.column(column))
    n = len(texts)
    if not n:
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), texts.slice(i, j - i)
        i = j
    release()


def release() -> None:
    """Give memory that is free back to the system: workers wait between stages, while others need it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of each maximal run of the table's bytes; runs end with their text."""
    inside = table[data]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray, fold: bool) -> np.ndarray:
    """Running polynomial sums, from which ``span_hash`` takes the hash of any byte range."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(data) + 1, _U)
        np.cumsum((_FOLDED if fold else _BYTES)[data] * powers(_BASE, len(data)), out=out[1:])
        return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal ranges have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * powers(_INV, len(sums))[starts] + (ends - starts).astype(_U))


class _Stored(dict):
    """Hashes of the words met so far. It starts anew when full, which changes speed only."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= STORE_BYTES:
            if len(self) >= STORE_WORDS:
                self.clear()
            self[word] = h
        return h


_stored = _Stored()


def words_of(texts: pa.Array, table: np.ndarray) -> Iterator[list[bytes]]:
    """The words (runs of the table's bytes) of each text of a large_string array, A-Z in lower case."""
    data, offsets = utf8(texts)
    raw = data.tobytes().translate(_SPLIT[table.tobytes()])
    at = offsets.tolist()
    for a, b in zip(at, at[1:], strict=False):
        yield raw[a:b].split()


def hashed(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hash (64 bits of BLAKE2) and text index of each word of some texts, in order."""
    count = [len(x) for x in words]
    return np.fromiter(map(_stored.__getitem__, chain.from_iterable(words)), _U, sum(count)), np.repeat(np.arange(len(count)), count)


_LANES = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def quick_hashes(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Another hash of each word, in order, and the number of words of each text: eight bytes at a time for all words at once, so no word is looked up.

    Words longer than ``STORE_BYTES`` go by 64 bits of BLAKE2. Each step is a bijection that scatters its input, so no sums of bytes collide.
    """
    data, offsets = utf8(texts)
    starts, ends, of = spans(data, offsets, table)
    raw = data.tobytes().translate(_SPLIT[table.tobytes()]) + bytes(8)
    lanes = np.ascontiguousarray(np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)))
    size = ends - starts
    with np.errstate(over="ignore"):
        out = mix(size.astype(_U) * _U(_BASE))
        left = np.flatnonzero(size > 0)
        for at in range(0, STORE_BYTES, 8):
            left = left[size[left] > at]
            if not len(left):
                break
            out[left] = mix(out[left] ^ (lanes[starts[left] + at] & _LANES[np.minimum(size[left] - at, 8)]))
    for i in np.flatnonzero(size > STORE_BYTES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out, np.bincount(of, minlength=len(texts))


def word_hashes(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of each word, in order."""
    return hashed(list(words_of(texts, table)))
