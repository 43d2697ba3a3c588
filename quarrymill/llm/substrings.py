"""Operator 4: removal of repeated substrings of ``LENGTH`` bytes, found with suffix arrays.

Every byte goes that lies in a string of LENGTH bytes which also starts anywhere else, in another document or in the same one.

* Each start of such a string chooses an anchor inside the string: the leftmost of its 16-byte grams with the least
  hash. Equal strings choose equal grams, so they meet under the gram's hash. Starts next to each other that
  choose the same anchor form a region.
* Only anchors that occur twice or more matter. Regions of one anchor with equal bytes (by length, place of the anchor and a
  cryptographic digest of 128 bits, BLAKE2) are one class; a class with two members is repeated as a whole.
* What is left are regions that are unlike any other as a whole but may share strings with them. Their bytes, and those of
  one member of each other class of the anchor, are gathered in blocks, with all classes of an anchor in one block. Parts
  whose middle bytes no other region has at that place are left out, the others go into the block's suffix array.
* An anchor with more classes than ``HOT`` is split by content first: strings at about the same place around the anchor share the bytes
  in their middle, and go where the hash of these says. Such slices form classes in their turn, and those of one middle meet in a block.
  A middle with more than ``HOT`` classes, as around a passage that very many documents hold, has too many for a block: the single strings of
  one member of each class are counted by their digests instead. So no block holds more than ``HOT`` classes of a key.
* A suffix array is sorted in two stages: suffixes smaller than their successors are sorted directly, down to
  LENGTH bytes; scanning the buckets of first bytes from left to right puts all others in their places. The common
  prefixes of neighbours then show the strings that occur twice.

Texts are UTF-8 bytes; null text counts as empty. Repeated rows are documents of their own, so they remove each other
from LENGTH bytes on. A null doc_id is kept as it is. An empty table gives an empty result; other columns of the input are dropped. What is left of a text may not be valid UTF-8, so it is binary.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import removed, scratch, written, written_at
from ._text import mix, pieces, prefix_hash, span_hash, utf8

LENGTH = 400
#: Bytes of a gram.
GRAM = 16
#: Bytes of regions in a block of suffixes.
BLOCK_BYTES = 1 << 20
#: Classes of an anchor above which it is split by content (no result depends on it), and strings' starts in a slice.
HOT = 2000
SLICE = 32
_U = np.uint64
_PLACE = (1 << 24) - 1


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Of each window, the place of its least value (its upper 40 bits count); the leftmost of equals."""
    out = []
    for base in range(0, len(values) - width + 1, 1 << 22):
        part = values[base : base + (1 << 22) + width - 1]
        n = len(part) - width + 1
        packed = np.full(-(-len(part) // width) * width, ~_U(0))
        packed[: len(part)] = (part & ~_U(_PLACE)) | np.arange(len(part), dtype=_U)
        table = packed.reshape(-1, width)
        ahead = np.minimum.accumulate(table, 1).reshape(-1)
        behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].reshape(-1)
        out.append((np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _U(_PLACE)).astype(np.int64) + base)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def digests(raw: bytes, starts: list[int], ends: list[int]) -> tuple[pa.Array, pa.Array]:
    """128 bits of BLAKE2 of each byte range, as two columns."""
    made = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts, ends, strict=True)])
    both = np.frombuffer(made, np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """A row for each region: g (hash of the anchor), doc_id, row (hash of the text), first (its first start), a (bytes before the anchor), b (starts less one), r and q (digest of its bytes), times and stretch (equal regions in a row, as in periodic text, are one row: how many, and from the first to the last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, most=1 << 20):
                data, offsets = utf8(texts)
                if len(data) < length:
                    continue
                sums = prefix_hash(data, False)
                at = np.arange(len(data) - GRAM + 1)
                grams = span_hash(sums, at, at + GRAM)
                least = sliding_least(grams, length - GRAM + 1)
                size = np.diff(offsets)
                most = np.repeat(offsets[1:] - length, size)[: len(least)]
                starts = np.flatnonzero(np.arange(len(least)) <= most)
                if not len(starts):
                    continue
                of = np.searchsorted(offsets, starts, "right") - 1
                chosen = least[starts]
                new = np.ones(len(starts), bool)
                new[1:] = (chosen[1:] != chosen[:-1]) | (of[1:] != of[:-1])
                firsts = np.flatnonzero(new)
                lasts = np.append(firsts[1:], len(starts)) - 1
                s1, s2, p, of = starts[firsts], starts[lasts], chosen[firsts], of[firsts]
                r, q = (x.to_numpy() for x in digests(data.tobytes(), s1.tolist(), (s2 + length).tolist()))
                new = np.ones(len(s1) + 1, bool)
                new[1:-1] = (of[1:] != of[:-1]) | (r[1:] != r[:-1]) | (q[1:] != q[:-1]) | (np.diff(p - s1) != 0) | (np.diff(s2 - s1) != 0) | (np.diff(s1) > length)
                run = np.flatnonzero(new)
                times, stretch, run = np.diff(run), s1[run[1:] - 1] - s1[run[:-1]], run[:-1]
                s1, s2, p, of, r, q = s1[run], s2[run], p[run], of[run], r[run], q[run]
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[p].view(np.int64)), part.column("doc_id").take(take), part.column("row").take(take), pa.array(s1 - offsets[of]), pa.array((p - s1).astype(np.int32)), pa.array((s2 - s1).astype(np.int32)), pa.array(r), pa.array(q), pa.array(times), pa.array(stretch)],
                    names=["g", "doc_id", "row", "first", "a", "b", "r", "q", "times", "stretch"],
                )

    return docs.select("doc_id", "row", "text").mapInArrow(run, "g long, doc_id long, row long, first long, a int, b int, r long, q long, times long, stretch long")


def _regions(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """key, doc_id, row, first, a, hot, r, q, bytes of each wanted region, or of its slices (with digests) if the anchor is hot."""
    lists = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("g", "first", "a", "b", "hot")).alias("w"))
    joined = docs.select("doc_id", "row", "text").join(lists.withColumnsRenamed({"doc_id": "_d", "row": "_r"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r"))).select("doc_id", "row", "text", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in pieces(batch, most=1 << 17):  # slices take many times the bytes of their text
                rows: list[tuple] = []
                for doc, row, text, want in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row", "text", "w")), strict=True):
                    data = text.encode()
                    for w in want:
                        g, s1, p, s2 = w["g"], w["first"], w["first"] + w["a"], w["first"] + w["b"]
                        if not w["hot"]:
                            rows.append((g, doc, row, s1, w["a"], False, 0, 0, data[s1 : s2 + length]))
                            continue
                        for j in range((p - s2) // SLICE, (p - s1) // SLICE + 1):
                            low, high = max(s1, p - SLICE * j - SLICE + 1), min(s2, p - SLICE * j)
                            if low <= high:
                                core = data[p - SLICE * j : p - SLICE * j - SLICE + 1 + length]
                                own = data[low : high + length]
                                rows.append((hash_bytes(core, g, j), doc, row, low, p - low, True, *struct.unpack("<qq", hashlib.blake2b(own, digest_size=16).digest()), own))
                for i in range(0, len(rows), 1 << 13):
                    key, doc_id, row, first, a, hot, r, q, held = zip(*rows[i : i + (1 << 13)], strict=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (key, doc_id, row, first, a)), pa.array(hot), pa.array(r, pa.int64()), pa.array(q, pa.int64()), pa.array(held, pa.binary())], names=["key", "doc_id", "row", "first", "a", "hot", "r", "q", "bytes"])

    return joined.mapInArrow(run, "key long, doc_id long, row long, first long, a long, hot boolean, r long, q long, bytes binary")


def _singles(slices: DataFrame, length: int) -> DataFrame:
    """key, doc_id, row, first, n, r, q: each string of the slices, and the members that its slice stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                held = part.column("bytes").to_pylist()
                n = np.array([len(x) - length + 1 for x in held])
                of = np.repeat(np.arange(len(held)), n)
                within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                base = np.cumsum([0, *map(len, held)])[of] + within
                digest = digests(b"".join(held), base.tolist(), (base + length).tolist())
                key, doc_id, row, count = (part.column(c).take(pa.array(of)) for c in ("key", "doc_id", "row", "n"))
                yield pa.RecordBatch.from_arrays([key, doc_id, row, pa.array(part.column("first").to_numpy()[of] + within), count, *digest], names=["key", "doc_id", "row", "first", "n", "r", "q"])

    return slices.select("key", "doc_id", "row", "first", "n", "bytes").mapInArrow(run, "key long, doc_id long, row long, first long, n long, r long, q long")


def hash_bytes(data: bytes, *more: int) -> int:
    """A signed 64-bit hash of the bytes and some numbers."""
    x = np.frombuffer(data, np.uint8)
    h = span_hash(prefix_hash(x, False), np.array([0]), np.array([len(x)]))
    for m in more:
        h = mix(h ^ np.array([m & 0xFFFFFFFFFFFFFFFF], _U))
    return int(h.view(np.int64)[0])


def _words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that sorts like them; zeros behind the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(_U)
    out = np.zeros(len(text), _U)
    for k in range(8):
        out = (out << _U(8)) | padded[k : k + len(text)]
    return out


def _sorted_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the suffixes there, as far as ``depth`` bytes tell them apart."""
    n = len(words)
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    tied = np.zeros(len(order) + 1, bool)
    tied[1:-1] = key[1:] == key[:-1]
    for off in range(8, depth, 8):
        active = np.flatnonzero(tied[:-1] | tied[1:])
        if not len(active):
            break
        group = np.cumsum(~tied[active])
        at = order[active] + off
        key = np.where(at < n, words[np.minimum(at, n - 1)], _U(0))
        fresh = np.lexsort((key, group))
        order[active] = order[active][fresh]
        key, group = key[fresh], group[fresh]
        same = np.zeros(len(active), bool)
        same[1:] = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
        tied[active] = same
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Two-stage sorting of all suffixes; suffixes alike for ``depth`` bytes stand together in some order."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    nearest = change[np.searchsorted(change, np.arange(n))]
    rises = np.zeros(n, bool)
    inside = nearest < n - 1
    rises[inside] = text[nearest[inside] + 1] > text[nearest[inside]]
    direct = _sorted_directly(np.flatnonzero(rises), _words_at(text), depth)
    cuts = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[text[n - 1]].append(np.array([n - 1]))  # what the empty suffix, the least of all, induces
    out = []
    for c in range(256):
        wave = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
        bucket.append(direct[cuts[c] : cuts[c + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[text[before] > c]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            edges = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for a, b in zip(edges, np.append(edges[1:], len(first)), strict=True):
                pending[first[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order, up to ``depth``."""
    n, words = len(text), _words_at(text)
    out = np.zeros(len(order), np.int64)
    active = np.arange(1, len(order))
    for off in range(0, depth, 8):
        i, j = order[active] + off, order[active - 1] + off
        inside = (i < n) & (j < n)
        active, i, j = active[inside], i[inside], j[inside]
        differ = words[i] ^ words[j]
        equal = differ == 0
        rest = active[~equal]
        lead = np.zeros(len(rest), np.int64)
        left = differ[~equal]
        for k in range(7, 0, -1):
            lead += left < (_U(1) << _U(8 * k))
        out[rest] += lead
        active = active[equal]
        out[active] += 8
    before = np.append(order[:1], order[:-1])
    return np.minimum(np.minimum(out, depth), n - np.maximum(order, before))


def shared_slices(key: np.ndarray, a: np.ndarray, held: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Region, least and largest start of the ranges of starts that can have an equal string in another place.

    Strings that start at about the same place before their anchor, within SLICE bytes, have the same middle if they are
    equal. So of each slice of a region the middle is hashed, and a slice whose middle no other has is left out.
    """
    sizes = np.array([len(x) for x in held])
    base = np.cumsum(sizes) - sizes
    b = sizes - length
    j0, j1 = (a - b) // SLICE, a // SLICE
    n = j1 - j0 + 1
    of = np.repeat(np.arange(len(held)), n)
    j = np.repeat(j0, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    sums = prefix_hash(np.frombuffer(b"".join(held), np.uint8), False)
    core = base[of] + a[of] - SLICE * j
    h = span_hash(sums, core, core + length - SLICE + 1)
    h = mix(mix(h ^ key[of].view(_U)) ^ j.astype(_U))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    keep = np.zeros(len(h), bool)
    keep[order[1:]] |= same
    keep[order[:-1]] |= same
    of, j = of[keep], j[keep]
    low, high = np.maximum(0, a[of] - SLICE * j - SLICE + 1), np.minimum(b[of], a[of] - SLICE * j)
    order = np.lexsort((low, of))
    of, low, high = of[order], low[order], high[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (low[1:] != high[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(of)) - 1 if len(of) else first
    return of[first], low[first], high[last]


def repeated_starts(regions: list[bytes], length: int) -> list[np.ndarray]:
    """Of each region, its starts whose strings of ``length`` bytes occur twice or more among all regions."""
    sizes = np.array([len(x) for x in regions])
    firsts = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\0".join(regions) + b"\0", np.uint8)
    order = suffix_array(text, length)
    shared = common_prefixes(text, order, length)
    valid = np.zeros(len(text) + 1, np.int64)
    np.add.at(valid, firsts, 1)
    np.add.at(valid, firsts + sizes - length + 1, -1)
    valid = np.cumsum(valid)[:-1] > 0
    run = np.cumsum(shared < length)
    members = np.bincount(run, valid[order])
    hit = np.zeros(len(text), bool)
    hit[order] = (members[run] >= 2) & valid[order]
    return [np.flatnonzero(hit[a : a + n]) for a, n in zip(firsts.tolist(), sizes.tolist(), strict=True)]


def _among(regions: DataFrame, length: int) -> DataFrame:
    """doc_id, row, first, end: covered ranges of regions that share strings."""

    def run(table: pa.Table) -> pa.Table:
        held = table.column("bytes").to_pylist()
        of, low, high = shared_slices(table.column("key").to_numpy(), table.column("a").to_numpy(), held, length)
        firsts, ends, source = [], [], []
        parts = [held[k][x : y + length] for k, x, y in zip(of.tolist(), low.tolist(), high.tolist(), strict=True)]
        for k, x, starts in zip(of.tolist(), low.tolist(), repeated_starts(parts, length) if parts else [], strict=True):
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > length)
                for p, q in zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True):
                    source.append(k)
                    firsts.append(x + p)
                    ends.append(x + q + length)
        base = table.column("first").to_numpy()[source] if source else np.zeros(0, np.int64)
        docs, rows = (table.column(c).take(pa.array(source, pa.int64())) for c in ("doc_id", "row"))
        return pa.table({"doc_id": docs, "row": rows, "first": base + np.array(firsts, np.int64), "end": base + np.array(ends, np.int64)})

    return regions.groupBy("block").applyInArrow(run, "doc_id long, row long, first long, end long")


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, row, s: the sorted ranges to remove (first, end; they may overlap) of every text that has one."""
    spark = docs.sparkSession
    found, path = written_at(anchors(docs, length))
    often = written(found.groupBy("g").agg(F.sum("times").alias("_n")).where("_n > 1").select("g"))  # a table of its own, so Spark can split a hot key of the join
    again, gone = written_at(found.join(often, "g"))
    removed(spark, path)
    same = ["g", "a", "b", "r", "q"]
    classes = written(again.groupBy(*same).agg(F.sum("times").alias("n"), F.min(F.struct("doc_id", "row", "first")).alias("m")))
    whole = written(again.join(classes.where("n > 1").select(*same), same).select("doc_id", "row", "first", (F.col("first") + F.col("stretch") + F.col("b") + length).alias("end")))
    removed(spark, gone)
    mixed = written(classes.groupBy("g").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 AND least = 1").select("g", (F.col("c") > HOT).alias("hot")))
    wanted = classes.join(mixed, "g").select("m.doc_id", "m.row", "m.first", "g", "a", "b", "hot")
    regions = written(_regions(wanted, docs, length))
    same, place = ["key", "a", "r", "q"], ["key", "doc_id", "row", "first", "a", "bytes"]
    slices = regions.where("hot")
    kinds = written(slices.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "first", "bytes")).alias("m")).select(*same, "n", "m.*"))
    equal = slices.join(kinds.where("n > 1").select(*same), same).select("doc_id", "row", "first", (F.col("first") + F.length("bytes")).alias("end"))
    split = written(kinds.groupBy("key").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 AND least = 1").select("key", (F.col("c") > HOT).alias("many")))
    left = kinds.join(split, "key")
    single = written(_singles(left.where("many"), length))
    often = written(single.groupBy("key", "r", "q").agg(F.sum("n").alias("_n")).where("_n > 1").select("key", "r", "q"))
    alone = single.join(often, ["key", "r", "q"]).select("doc_id", "row", "first", (F.col("first") + length).alias("end"))
    whole = whole.unionByName(written(equal)).unionByName(written(alone))  # each by itself, so Spark can split a hot key of its join
    met = written(regions.where("NOT hot").select(*place).unionByName(left.where("NOT many").select(*place)))
    total = met.agg(F.sum(F.length("bytes"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    shared = written(_among(met.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))), length))
    return whole.unionByName(shared).groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("s"))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, removed (array of first, end: maximal removed runs) and kept (binary) of every row."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    kept: list[str] = []
    with scratch(docs.sparkSession, kept):  # the spans stay in the shared folder, all other tables are deleted
        cut, path = written_at(spans(keyed, length))
        kept.append(path)
    cut = cut.withColumnsRenamed({"doc_id": "_d", "row": "_r"})
    joined = keyed.join(cut, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")), "left").select("doc_id", "text", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                data, offsets = utf8(texts)
                raw = data.tobytes()
                kept, removed = [], []
                for i, s in enumerate(part.column("s").to_pylist()):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    runs: list[list[int]] = []
                    for x in s or ():
                        if runs and x["first"] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], x["end"])
                        else:
                            runs.append([x["first"], x["end"]])
                    edges = [0, *(e for r in runs for e in r), b - a]
                    kept.append(b"".join(raw[a + x : a + y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                    removed.append([{"first": x, "end": y} for x, y in runs])
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<first long, end long>>, kept binary")
