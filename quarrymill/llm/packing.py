"""Operator 6: token ids in bit-packed binary files.

A file holds blocks of ids, each id in the fewest bits that the vocabulary needs. Layout, little-endian: magic
``QMPK``, version, bits for an id, ids for a block (each unsigned 32), the packed blocks, the blocks' byte offsets,
the documents' first ids, the numbers of blocks, documents and ids (each unsigned 64). What grows with the file
stands at the end, so a file is written in one go, a block at a time, and read from any block. The number of files follows the bytes
of the texts, ``FILE_BYTES`` of them for each, so what a task writes, and the offsets it holds, stay bounded.

Documents are dealt out by ranges of doc_id and sorted within each range, so the files in their order hold all
ids in ascending order of doc_id. Rows of one doc_id are ordered by their text; a null doc_id comes first, a null
text counts as empty. Only one row for each file reaches the driver. A file gets its name when it is complete;
a task that runs again, on whatever executor, writes the same bytes under the same name.
An empty table makes no file. Other columns of the documents are dropped; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import io
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from itertools import count as count_from

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import shared_folder, written
from ._text import pieces, utf8
from .chunks import ChunkEncoder

MAGIC = b"QMPK"
#: Ids for a block.
BLOCK = 1 << 16
#: Bytes of texts for a file, about; and rows that are read from a file at a time.
FILE_BYTES = 32 << 20
#: Ranges of doc_id at most, each a task that writes as many files as its texts need.
MOST_RANGES = 16_384
ROWS = 1 << 16
#: Chunks that are handed to the library at a time.
JOINED = 1024
_BLANK = frozenset(" \t\n\v\f\r")
_HEAD = struct.Struct("<4sIII")
_TAIL = struct.Struct("<QQQ")


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below the vocabulary's size."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids side by side, lowest bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The inverse of ``pack``."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    if bits == 32:
        return np.frombuffer(data, "<u4", n).copy()
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = spread
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n)


class PackedWriter:
    """Writes one file; memory holds a block, and the number of offsets that the file has."""

    def __init__(self, out: io.IOBase, vocabulary: int, block: int = BLOCK) -> None:
        self.out, self.bits, self.block = out, bits_for(vocabulary), block
        self.rest: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.offsets: list[int] = []
        self.starts: list[int] = []
        self.size = out.write(_HEAD.pack(MAGIC, 1, self.bits, block))

    def add(self, ids: np.ndarray) -> None:
        """One document more."""
        self.starts.append(self.total)
        self.rest.append(ids)
        self.total += len(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            ids = np.concatenate(self.rest)
            whole = len(ids) // self.block * self.block
            for i in range(0, whole, self.block):
                self._block(ids[i : i + self.block])
            self.rest, self.waiting = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.size)
        self.size += self.out.write(pack(ids, self.bits))

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.rest))
        self.out.write(np.array(self.offsets, "<u8").tobytes() + np.array(self.starts, "<u8").tobytes() + _TAIL.pack(len(self.offsets), len(self.starts), self.total))


class PackedReader:
    """Random access to the ids and documents of an open file that can seek; holds its offsets and one block."""

    def __init__(self, file: io.IOBase) -> None:
        self.file = file
        magic, _, self.bits, self.block = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        size = file.seek(0, io.SEEK_END)
        blocks, self.documents, self.total = _TAIL.unpack(self._read(size - _TAIL.size, _TAIL.size))
        at = size - _TAIL.size - 8 * (blocks + self.documents)
        numbers = np.frombuffer(self._read(at, 8 * (blocks + self.documents)), "<u8").astype(np.int64)
        self.offsets = np.append(numbers[:blocks], at)
        self.starts = np.append(numbers[blocks:], self.total)
        self._held: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, b: int) -> np.ndarray:
        if self._held[0] != b:
            data = self._read(int(self.offsets[b]), int(self.offsets[b + 1] - self.offsets[b]))
            self._held = b, unpack(data, self.bits, min(self.block, self.total - b * self.block))
        return self._held[1]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end (exclusive), from their blocks only."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        out = np.concatenate([self._block(b) for b in range(first, last + 1)])
        return out[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def byte_encoder(path: str) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Encodes texts with a file of the tokenizers library or with a .tiktoken ranks file; chunks are kept for reuse.

    New chunks that begin with a blank and end without one are handed to the library as one text, as its pre-tokenisation begins anew at each of them; the
    tokens' bytes tell them apart again.
    """
    if path not in _encoders:
        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})

            def encoded(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                held = [own.encode(x, allowed_special="all") for x in texts]
                count = np.array([len(x) for x in held], np.int64)
                return [(np.arange(len(texts)), np.fromiter(chain.from_iterable(held), np.uint32, int(count.sum())), count)]

        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            size = np.zeros(library.get_vocab_size(), np.int64)
            for token, i in library.get_vocab(with_added_tokens=False).items():
                size[i] = len(token)  # a character for each byte

            def encoded(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                out = []
                alone = [k for k, x in enumerate(texts) if x[:1] not in _BLANK or x[-1:] in _BLANK]
                whole = set(alone)
                chunks = [k for k in range(len(texts)) if k not in whole]
                for i in range(0, len(chunks), JOINED):
                    part = chunks[i : i + JOINED]
                    ids = np.array(library.encode("".join([texts[k] for k in part]), add_special_tokens=False).ids, np.uint32)
                    ends, wanted = np.cumsum(size[ids]), np.cumsum([len(texts[k].encode()) for k in part])
                    cuts = np.searchsorted(ends, wanted) + 1
                    if len(ids) and cuts[-1] == len(ids) and (ends[cuts - 1] == wanted).all():
                        out.append((np.array(part), ids, np.diff(cuts, prepend=0)))
                    else:  # a token across a border; none is known
                        alone += part
                held = [x.ids for x in library.encode_batch([texts[k] for k in alone], add_special_tokens=False)]
                count = np.array([len(x) for x in held], np.int64)
                return [*out, (np.array(alone, np.int64), np.fromiter(chain.from_iterable(held), np.uint32, int(count.sum())), count)]

        def many(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found, count = encoded(texts), np.zeros(len(texts), np.int64)
            for which, _, n in found:
                count[which] = n
            start, ids = np.cumsum(count) - count, np.zeros(int(count.sum()), np.uint32)
            for which, own, n in found:
                ids[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(len(own))] = own
            return ids, count

        _encoders[path] = ChunkEncoder(many, False)
    return _encoders[path].encode


_encoders: dict[str, ChunkEncoder] = {}


def write(docs: DataFrame, path: str, vocabulary: int, end_id: int, files: int | None = None) -> tuple[str, DataFrame]:
    """Write the files to the shared folder; its URI, and the table of files: part (of the order of doc_id), name (in order within it), ids, documents.

    A range of doc_id is a task, of which there are ``MOST_RANGES`` at most; it begins another file when one has ``FILE_BYTES`` of text and more is to come than a half of that, and
    so holds the offsets of one file at a time.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    if not files:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = min(MOST_RANGES, max(spark.sparkContext.defaultParallelism, -(-total // FILE_BYTES)))
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        encode, part, finish = byte_encoder(path), context.partitionId(), np.array([end_id], np.uint32)
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)
        held = (x for batch in batches for x in pieces(batch))
        following = next(held, None)
        for k in count_from(0):
            if following is None:
                return
            name = f"part-{part:06d}-{k:06d}.qmpk"
            kept = f"{top}/.{name}.{context.taskAttemptId()}"
            size, documents, ids_of = 0, 0, []
            with store.open_output_stream(kept) as out:
                writer = PackedWriter(out, vocabulary)
                while following is not None and size < 1.5 * FILE_BYTES:
                    rows, texts = following
                    ids_of.append(rows.column("doc_id"))
                    data, offsets = utf8(texts)
                    size += len(data)
                    ids, counts = encode(data, offsets)
                    at = 0
                    for c in counts.tolist():
                        writer.add(np.concatenate([ids[at : at + c], finish]))
                        at += c
                    documents += len(counts)
                    following = next(held, None)
                writer.close()
            with store.open_output_stream(f"{kept}.ids") as out, pa.ipc.new_stream(out, pa.schema([("doc_id", pa.int64())])) as table:
                table.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays(ids_of)], names=["doc_id"]))
            store.move(f"{kept}.ids", f"{top}/{name}.ids")
            store.move(kept, f"{top}/{name}")
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "ids": [writer.total], "documents": [documents]})

    return folder, written(ordered.mapInArrow(run, "part long, name string, ids long, documents long"))


def read_digests(docs: DataFrame, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files; start counts the ids of all files before."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    sums = files.groupBy("part").agg(F.sum("ids").alias("_sum"))  # a row for each range, ``MOST_RANGES`` at most
    parts = sums.select("part", (F.sum("_sum").over(Window.orderBy("part")) - F.col("_sum")).alias("_before"))
    within = F.sum("ids").over(Window.partitionBy("part").orderBy("name")) - F.col("ids")
    numbers = files.withColumn("_within", within).join(parts, "part").select("name", (F.col("_within") + F.col("_before")).alias("before"))
    tasks = max(1, min(MOST_RANGES, files.count()))
    list_of = numbers.repartition(tasks, "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with store.open_input_file(f"{top}/{name}") as f:
                    reader = PackedReader(f)
                    with store.open_input_stream(f"{top}/{name}.ids") as g:
                        doc_id = pa.ipc.open_stream(g).read_all().column("doc_id").combine_chunks()
                    size = np.diff(reader.starts)
                    for i in range(0, reader.documents, ROWS):
                        crc = [zlib.crc32(reader.document(k).astype("<u4").tobytes()) for k in range(i, min(i + ROWS, reader.documents))]
                        yield pa.RecordBatch.from_arrays([doc_id.slice(i, ROWS), pa.array(reader.starts[:-1][i : i + ROWS] + start), pa.array(size[i : i + ROWS]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return list_of.mapInArrow(run, schema)
