"""Operator 9: chat formatting by assembly of tokens.

Each role and each text is encoded by itself; ids beyond the vocabulary are reserved for the start and the end
of a turn and spliced between the segments, so no text can ever produce them. In the plain-text form of a
conversation, control strings that occur in a text are escaped by a backslash, and so is the backslash, which
makes the form reversible. The loss mask is 1 from an assistant's text to its end: +1 and -1 at the borders of
these segments, summed up from the left.

A conversation is all rows of one conv_id (null is one of its own), ordered by turn, then role, then text, nulls
first; repeated rows are turns of their own. Null role or text counts as empty. An empty table gives no rows. Other columns of
the rows are dropped; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"\\|<\|")
_ROLE = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(text: str) -> str:
    """The text without a control string: a backslash before each backslash and each '<|'."""
    return _CONTROL.sub(lambda m: "\\" + m[0] if m[0] == "\\" else "<\\|", text)


def unescaped(text: str) -> str:
    """The inverse of ``escaped``."""
    return _ESCAPED.sub(r"\1", text)


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and its ordered turns; a group is one conversation, whose length no copy of it adds to."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))


class Template:
    """Assembles and reads token lists; the two reserved ids follow the vocabulary."""

    def __init__(self, path: str) -> None:
        self.bpe = load(path)
        self.start, self.end = self.bpe.size, self.bpe.size + 1

    def _ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.bpe.encode(text, specials=False), "<u4")

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of a conversation."""
        segments, flags = [], []
        for role, text in turns:
            for ids, flag in ((np.array([self.start], "<u4"), 0), (self._ids(escaped(role).replace("\n", "\\\n") + "\n"), 0), (self._ids(escaped(text)), int(role == "assistant")), (np.array([self.end], "<u4"), 0), (self._ids("\n"), 0)):
                segments.append(ids)
                flags.append(flag)
        if not segments:
            return np.zeros(0, "<u4"), np.zeros(0, np.int8)
        sizes = np.array([len(x) for x in segments])
        ends = np.cumsum(sizes)
        steps = np.zeros(int(ends[-1]) + 1, np.int64)
        on = np.array(flags, np.int64)
        np.add.at(steps, ends - sizes, on)
        np.add.at(steps, ends, -on)
        return np.concatenate(segments), np.cumsum(steps)[:-1].astype(np.int8)

    def text(self, ids: np.ndarray) -> str:
        """The plain-text form of the ids."""
        cuts = np.flatnonzero(ids >= self.start)
        out, at = [], 0
        for c in cuts:
            out += [self.bpe.decode(ids[at:c]).decode(), START if ids[c] == self.start else END]
            at = c + 1
        return "".join([*out, self.bpe.decode(ids[at:]).decode()])

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], str]:
        """Turns and the text under the mask, both unescaped, from the assembled form alone."""
        turns, loss = [], []
        firsts, lasts = np.flatnonzero(ids == self.start), np.flatnonzero(ids == self.end)
        for a, b in zip(firsts, lasts, strict=True):
            whole = self.bpe.decode(ids[a + 1 : b]).decode()
            head = _ROLE.match(whole)
            turns.append((unescaped(head[1]), unescaped(whole[head.end() :])))
            if len(under := ids[a + 1 : b][mask[a + 1 : b] == 1]):
                loss.append(unescaped(self.bpe.decode(under).decode()))
        return turns, "".join(loss)


def formatted(rows: DataFrame, path: str) -> DataFrame:
    """conv_id, ids, mask (one entry for each id) and the plain-text form of every conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                made = [template.assemble([(t["role"], t["text"]) for t in turns]) for turns in part.column("turns").to_pylist()]
                ends = pa.array(np.cumsum([0, *(len(x) for x, _ in made)]), pa.int32())
                ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x for x, _ in made]).astype(np.int32)))
                mask = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([m for _, m in made]).astype(np.int8)))
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), ids, mask, pa.array([template.text(x) for x, _ in made], pa.string())], names=["conv_id", "ids", "mask", "formatted"])

    return conversations(rows).mapInArrow(run, "conv_id long, ids array<int>, mask array<tinyint>, formatted string")


def read_back(made: DataFrame, path: str) -> DataFrame:
    """Digests of what ``formatted`` holds, by reading its ids, its mask and its text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(path)
        for batch in batches:
            out = []
            for ids, mask, text in zip(batch.column("ids"), batch.column("mask"), batch.column("formatted"), strict=True):
                turns, loss = template.read(ids.values.to_numpy().astype("<u4"), mask.values.to_numpy())
                if template.text(ids.values.to_numpy().astype("<u4")) != text.as_py():
                    raise ValueError("the ids and the text of a conversation differ")
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text.as_py())))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return made.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
