"""Operator 12: vector code compression, a codebook for each part of the vectors fitted by Elkan's form of Lloyd's rounds.

* A component x becomes the integer floor(scale * x), so all sums, distances and means (floored) are exact.
* Vectors are cut into ``parts`` equal parts (zeros fill the last one up). Each part has a codebook of ``entries`` vectors,
  at first those of the smallest ids. A round assigns each part to its nearest entry, ties to the lower index,
  then moves each entry to the floored mean of its parts; an unused entry stays. A last assignment gives codes and errors.
* Assignments are Elkan's. A row keeps, for each part, an upper bound of the distance to its entry and one lower bound for
  each entry, in a table of the shared folder between the rounds. When entries move, bounds are shifted by their
  movement. Entry j cannot be nearest if its lower bound, or half its distance from the current entry, is strictly above
  the upper bound; a row whose upper bound is strictly below half the distance to the nearest other entry is not looked at at all.
  What remains is computed in integers, so ties are told exactly. Bounds are rounded to the safe side and a lower bound takes one
  byte, a share of the row's largest one.
* The codebooks (``parts * entries`` vectors, whatever the table holds) are sent to the tasks, and sums of parts by entry are
  added up in the tasks, then by entry.

Rows whose vector is null, empty, or holds nulls, NaN or infinities are dropped, as are those with another length than the vector of the
smallest kept id. Components beyond ``MOST`` / scale count as that bound. Fewer rows than entries make a smaller codebook. Repeated ids and
rows are rows of their own; null ids come last. Other columns are dropped, whatever their names. No kept row gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import removed, written, written_at
from ._vectors import binary, blocks, first_width, integers, matrix, unpacked

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Components beyond this count as this, so that squared distances fit 64 bits.
MOST = float(1 << 27)
#: Rows that are worked on at a time, and pairs of rows and entries.
_ROWS = 2048
_PAIRS = 1 << 16
#: Bounds are widened by this share, which covers the rounding of square roots and sums.
_SAFE = 1e-6


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y, exact: by one product of matrices where doubles hold all sums, else entry by entry."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * x.shape[1] * largest * largest < 1 << 53:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in y], 1)


class Entries:
    """One part's codebook, with what prunes: how far entries moved, and half their distances. Sent to the tasks."""

    def __init__(self, rows: np.ndarray, before: np.ndarray | None) -> None:
        self.rows = rows
        self.moved = np.zeros(len(rows)) if before is None else np.sqrt(((rows - before) ** 2).sum(1).astype(np.float64)) * (1 + _SAFE)
        self.half = np.sqrt(gaps(rows, rows).astype(np.float64)) / 2 * (1 - _SAFE)
        apart = self.half.copy()
        np.fill_diagonal(apart, np.inf)
        self.nearest = apart.min(1)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry, upper bound and lower bounds of each row, without bounds from before."""
        d = gaps(x, self.rows)
        code = d.argmin(1)
        far = np.sqrt(d.astype(np.float64))
        return code, far[np.arange(len(x)), code] * (1 + _SAFE), far * (1 - _SAFE)

    def again(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from bounds of before, which are changed in place, and how many distances were computed."""
        upper += self.moved[code]
        lower -= self.moved
        np.maximum(lower, 0, out=lower)
        rows = np.flatnonzero(upper >= self.nearest[code])
        rows = rows[self._open(rows, code, upper, lower).any(1)]
        own = ((x[rows] - self.rows[code[rows]]) ** 2).sum(1)
        exact = np.sqrt(own.astype(np.float64))
        upper[rows], lower[rows, code[rows]] = exact * (1 + _SAFE), exact * (1 - _SAFE)
        at, entry = np.nonzero(self._open(rows, code, upper, lower))
        far = np.concatenate([np.zeros(0, np.int64), *(((x[rows[at[i : i + _PAIRS]]] - self.rows[entry[i : i + _PAIRS]]) ** 2).sum(1) for i in range(0, len(at), _PAIRS))])
        lower[rows[at], entry] = np.sqrt(far.astype(np.float64)) * (1 - _SAFE)
        order = np.lexsort((entry, far, at))
        best = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
        won = best[(far[best] < own[at[best]]) | (far[best] == own[at[best]]) & (entry[best] < code[rows[at[best]]])]
        code[rows[at[won]]] = entry[won]
        upper[rows[at[won]]] = np.sqrt(far[won].astype(np.float64)) * (1 + _SAFE)
        return code, upper, lower, len(rows) + len(at)

    def _open(self, rows: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Of each row, the other entries that bounds do not rule out."""
        bound, own = upper[rows][:, None], code[rows]
        out = (lower[rows] <= bound) & (self.half[own] <= bound)
        out[np.arange(len(rows)), own] = False
        return out


_STATE = "parts binary, codes binary, bounds binary, lower binary"


def _packed(part: pa.RecordBatch, x: np.ndarray, found: list[tuple]) -> pa.RecordBatch:
    """Rows of the table that is kept between rounds."""
    upper = np.stack([u for _, u, _ in found], 1)
    unit = np.stack([np.maximum(low.max(1), 1e-30) / 255 for _, _, low in found], 1).astype(np.float32)
    bytes_ = np.concatenate([np.minimum(255, np.floor(low / unit[:, [p]].astype(np.float64))).astype(np.uint8) for p, (_, _, low) in enumerate(found)], 1)
    above = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
    codes = np.stack([c for c, _, _ in found], 1).astype(np.uint8)
    return pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), binary(x.astype(np.int32)), binary(codes), binary(np.concatenate([above, unit], 1)), binary(bytes_)], names=["id", "label", "parts", "codes", "bounds", "lower"])


def _bounds(part: pa.RecordBatch, parts: int, entries: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code, upper bound and lower bounds of each part, as they were kept."""
    codes, kept = unpacked(part.column("codes"), np.uint8, parts), unpacked(part.column("bounds"), np.float32, 2 * parts).astype(np.float64)
    lower = unpacked(part.column("lower"), np.uint8, parts * entries)
    return [(codes[:, p].astype(np.int64), kept[:, p].copy(), lower[:, p * entries : (p + 1) * entries] * (kept[:, [parts + p]] * (1 - _SAFE))) for p in range(parts)]


def _assigned(rows: DataFrame, books: list[Entries], size: int, start: bool, last: bool) -> DataFrame:
    """All parts assigned: the table to be kept, or in the end id, label, code, error."""
    spark, parts, entries = rows.sparkSession, len(books), len(books[0].rows)
    sent = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for part in blocks(batches, _ROWS):
            x = matrix(part, "x", size) if start else unpacked(part.column("parts"), np.int32, parts * books[0].rows.shape[1]).astype(np.int64)
            x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
            cut = np.split(x, parts, 1)
            if start:
                found = [b.first(c) for b, c in zip(books, cut, strict=True)]
            else:
                found = [b.again(c, *held)[:3] for b, c, held in zip(books, cut, _bounds(part, parts, entries), strict=True)]
            if last:
                error = sum(((c - b.rows[f[0]]) ** 2).sum(1) for b, c, f in zip(books, cut, found, strict=True))
                code = np.stack([f[0] for f in found], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array([r.tobytes().hex() for r in code], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])
            else:
                yield _packed(part, x, found)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in ("id", "label"))
    return rows.mapInArrow(run, f"{kinds}, " + ("code string, error long" if last else _STATE))


def _moved(kept: DataFrame, books: list[Entries]) -> list[Entries]:
    """The codebooks with each entry at the floored mean of its parts."""
    parts, entries, width = len(books), len(books[0].rows), books[0].rows.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for part in blocks(batches, _ROWS):
            slot = (unpacked(part.column("codes"), np.uint8, parts).astype(np.int64) + np.arange(parts) * entries).reshape(-1)
            np.add.at(total, slot, unpacked(part.column("parts"), np.int32, width))
            count += np.bincount(slot, minlength=len(count))
        used = np.flatnonzero(count)
        ends = pa.array(np.arange(len(used) + 1) * width, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.ListArray.from_arrays(ends, pa.array(total[used].reshape(-1)))], names=["slot", "n", "sums"])

    sums = kept.select("parts", "codes").mapInArrow(run, "slot long, n long, sums array<long>").groupBy("slot").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
    rows = [b.rows.copy() for b in books]
    for r in sums.collect():  # parts * entries rows at most
        rows[r.slot // entries][r.slot % entries] = np.array(r.sums, np.int64) // r.n
    return [Entries(new, b.rows) for new, b in zip(rows, books, strict=True)]


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """id, label, code (hex digits by part) and error of each kept row as a written table, and the codebook of each part."""
    rows = integers(vectors, scale, 0, MOST, vector, "x", F.col(id_).alias("id"), F.col(label).alias("label"))
    size = first_width(rows, "id", "x")
    rows = rows.where(F.size("x") == size)
    first = [r.x for r in rows.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()]
    if not first:
        return written(rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))), [np.zeros((0, 0), np.int64)] * parts
    start = np.pad(np.array(first, np.int64), ((0, 0), (0, -size % parts)))
    books, before = [Entries(b, None) for b in np.split(start, parts, 1)], None
    for k in range(rounds):
        kept, path = written_at(_assigned(rows, books, size, not k, False))
        if before:
            removed(rows.sparkSession, before)
        books, rows, before = _moved(kept, books), kept, path
    out = written(_assigned(rows, books, size, not rounds, True))
    if before:
        removed(rows.sparkSession, before)
    return out, [b.rows for b in books]


def digest(books: list[np.ndarray]) -> str:
    """Hex SHA-256 of all components, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def decoded(coded: DataFrame, books: list[np.ndarray], code: str = "code", out: str = "x") -> DataFrame:
    """coded with out, the integer vector that its code stands for (with the zeros that fill the last part up)."""
    entry = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    tables = [F.lit([[int(v) for v in row] for row in b]) for b in books]
    return coded.withColumn(out, F.concat(*(F.get(t, entry(p)) for p, t in enumerate(tables))))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (errors of equal labels, nulls together), codebooks_sha256."""
    coded, books = fit(vectors, parts, entries, rounds)
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    out = coded.join(total, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
