"""Vectors of floats as vectors of integers, and blocks of rows for numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integers(df: DataFrame, scale: int, offset: int, most: float, vector: str, out: str, *others: str) -> DataFrame:
    """The other columns, and out: floor(scale * c) + offset of each component c, held within ``most``.

    Rows whose vector is null, empty, or holds a null, NaN or infinity are dropped.
    """
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * float(scale), F.lit(most)), F.lit(-most))).cast("long") + F.lit(offset).cast("long"))
    return df.where(F.coalesce(finite & (F.size(vector) > 0), F.lit(False))).select(*others, whole.alias(out))


def first_width(df: DataFrame, id_: str, vector: str) -> int:
    """Length of the vector with the smallest id, null last; 0 without rows."""
    row = df.select(F.size(vector).alias("n"), id_).orderBy(F.asc_nulls_last(id_), "n").limit(1).first()
    return row.n if row else 0


def matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """A column of arrays of one length, without nulls, as rows of int64."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows at most."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as a binary value."""
    rows = np.ascontiguousarray(rows)
    size = rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    ends = np.arange(len(rows) + 1, dtype=np.int64) * size
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)]).cast(pa.binary())


def unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """What ``binary`` has packed."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, width)
