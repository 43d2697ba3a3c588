"""Exact nearest neighbours of a stated query set without all pairs: sets by rare members, vectors by pivots, names by shared pieces.

Each result counts in ``compared`` the pairs that were looked at in full for its query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

#: Rare members of a query that give its first neighbours.
PROBES = 4
#: Pivots at most; each row is kept with the nearest one.
PIVOTS = 256
#: Rows of a pivot that meet queries in one task, on average, and queries that meet them at once.
ROWS = 8192
STRIP = 256
#: Decimals to which similarities are equal.
TANIMOTO_DECIMALS = 9
COSINE_DECIMALS = 6


def nearest_sets(df: DataFrame, id_: str, items: str, queries: Column) -> DataFrame:
    """query, id, tanimoto, compared: the row most similar to each row of ``queries`` (a condition), itself excluded; of equals the smaller id.

    Rows with the same set are one class, so a query whose set occurs again is done at once. Others look for classes in an
    inverted list of members. A first look takes the classes that share one of a query's ``PROBES`` rarest members and gives
    a similarity t that its best reaches. A set as similar as t holds one of the query's |Q| - ceil(t |Q|) + 1 rarest members, and has
    t |Q| to |Q| / t of them, so the second look is complete. A query that shares no member with any row gets similarity 0 and the smallest id.
    """
    rows = df.select(F.col(id_).alias("id"), F.sort_array(F.array_distinct(items)).alias("s"), queries.alias("asked")).where("id IS NOT NULL AND size(s) > 0")
    both = rows.groupBy("s").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.sum(F.col("asked").cast("int")).alias("asked"))
    classes = kept(both.withColumn("size", F.size("s")))
    second = rows.join(classes.where("n > 1").select("s", F.col("id").alias("_first")), "s").where("id <> _first").groupBy("s").agg(F.min("id").alias("_second"))
    again = rows.where("asked").join(classes.where("n > 1").select("s", F.col("id").alias("_first")), "s").join(second, "s")
    copies = again.select(F.col("id").alias("query"), F.when(F.col("id") == F.col("_first"), F.col("_second")).otherwise(F.col("_first")).alias("id"), F.lit(1.0).alias("tanimoto"), F.lit(0).cast("long").alias("compared"))

    listed = kept(classes.select("id", "size", F.explode("s").alias("m")))
    counts = listed.groupBy("m").agg(F.count("*").alias("f"))
    single = classes.where("n = 1 AND asked > 0").select(F.col("id").alias("query"), F.col("size").alias("q_size"), F.explode("s").alias("m")).join(counts, "m").where("f > 1")
    place = F.row_number().over(Window.partitionBy("query").orderBy("f", "m"))
    asked = kept(single.select("query", "q_size", "m", place.alias("k"), (F.col("q_size") - F.count("*").over(Window.partitionBy("query"))).alias("alone")))

    best = F.max(F.struct("tanimoto", (-F.col("id")).alias("_id")))
    meet = lambda members: members.join(listed, "m").where("id <> query")
    probed = meet(asked.where(F.col("k") <= PROBES)).select("query", "id").distinct()
    first = kept(_tanimoto(probed, classes).groupBy("query").agg(best.alias("b"), F.count("*").alias("c")))
    bound = first.select("query", F.col("b.tanimoto").alias("t"))
    # members that no other class has come first in the order of rareness, so they use up places of the prefix
    prefix = F.col("q_size") - F.ceil(F.col("t") * F.col("q_size") - 1e-6) + 1 - F.col("alone")
    rest = asked.join(bound, "query", "left").where(F.col("t").isNull() | (F.col("k") <= prefix))
    t = F.coalesce("t", F.lit(0.0))
    near = meet(rest).where((F.col("size") >= t * F.col("q_size") - 1e-6) & (F.col("size") * t <= F.col("q_size") + 1e-6)).select("query", "id").distinct()
    second_look = _tanimoto(near, classes).groupBy("query").agg(best.alias("b"), F.count("*").alias("c"))
    found = second_look.unionByName(first).groupBy("query").agg(F.max("b").alias("b"), F.sum("c").alias("compared"))
    least = [r.id for r in rows.select("id").distinct().orderBy("id").limit(2).collect()]
    other = F.when(F.col("query") == F.lit(least[0] if least else None), F.lit(least[1] if len(least) > 1 else None)).otherwise(F.lit(least[0] if least else None))
    lonely = classes.where("n = 1 AND asked > 0").select(F.col("id").alias("query"))
    done = lonely.join(found, "query", "left")
    some = F.col("b.tanimoto") > 0
    single_out = done.select("query", F.when(some, -F.col("b._id")).otherwise(other).alias("id"), F.coalesce("b.tanimoto", F.lit(0.0)).alias("tanimoto"), F.coalesce("compared", F.lit(0)).cast("long").alias("compared"))
    return copies.unionByName(single_out.where("id IS NOT NULL"))


def _tanimoto(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """query, id, tanimoto of pairs of classes."""
    q = classes.select(F.col("id").alias("query"), F.col("s").alias("_q"))
    shared = F.size(F.array_intersect("s", "_q"))
    full = pairs.join(classes.select("id", "s"), "id").join(q, "query")
    return full.select("query", "id", F.round(shared / (F.size("s") + F.size("_q") - shared), TANIMOTO_DECIMALS).alias("tanimoto"))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    a = batch.column(column)
    return a.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(a), -1)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    held = column.combine_chunks()
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def nearest_vectors(df: DataFrame, id_: str, vector: str, queries: Column, pivots: int = PIVOTS) -> DataFrame:
    """query, id, cosine (rounded), compared: the row of the highest cosine for each row of ``queries`` (a condition), itself excluded; of equals the smaller id.

    Vectors are scaled to length 1, where the highest cosine is the least distance. Up to ``pivots`` rows, the first by hash, are pivots; every
    row is kept with its nearest pivot and the distance r from it. A query is compared with the rows of its own pivot first, which gives a
    distance b. A row nearer than b, at r from its pivot, has |d - r| <= b for the query's distance d from that pivot, so all others are left
    out, and a pivot whose rows all fail this is not looked at. Rows without direction (null, zero or not finite) take no part; all vectors have one length.
    """
    spark = df.sparkSession
    fine = F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(vector, lambda c: c != 0), F.lit(False))
    rows = df.where(fine & F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.transform(vector, lambda c: c.cast("double")).alias("v"), queries.alias("asked"))
    chosen = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()]  # pivots rows
    if not chosen:
        return spark.createDataFrame([], f"query {dict(df.dtypes)[id_]}, id {dict(df.dtypes)[id_]}, cosine double, compared long")
    sent = spark.sparkContext.broadcast(_unit(np.array(chosen)))
    kind = rows.schema["id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _unit(_rows(batch, "v"))
                gap = np.sqrt(np.maximum(0, 2 - 2 * v @ sent.value.T))
                near = gap.argmin(1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("asked"), flat, pa.array(near), pa.array(gap[np.arange(len(v)), near])], names=["id", "asked", "v", "pivot", "r"])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _rows(batch, "v")
                gap = np.sqrt(np.maximum(0, 2 - 2 * v @ sent.value.T))
                again = np.repeat(np.arange(len(v)), gap.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(again)), pa.array(np.tile(np.arange(gap.shape[1]), len(v))), pa.array(gap.reshape(-1))], names=["query", "pivot", "d"])

    def look(asked: pa.Table, rows: pa.Table) -> pa.Table:
        """For each query of a group, its best row of the group and how many were compared; queries and rows meet as a product of matrices."""
        out: list[tuple] = []
        if asked.num_rows and rows.num_rows:
            ids, r = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("id", "r"))
            order = np.argsort(ids, kind="stable")  # of equal cosines the first is then the smallest id
            ids, r, v = ids[order], r[order], _matrix(rows.column("v"))[order]
            query, d, reach = (asked.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("query", "d", "_reach"))
            q = _matrix(asked.column("q"))
            low, high = np.searchsorted(ids, query, "left"), np.searchsorted(ids, query, "right")
            for at in range(0, len(query), STRIP):
                s = slice(at, at + STRIP)
                cos = np.round(q[s] @ v.T, COSINE_DECIMALS)
                cos[np.abs(d[s, None] - r) > np.where(np.isnan(reach[s]), np.inf, reach[s])[:, None]] = -np.inf
                for k, (x, y) in enumerate(zip(low[s], high[s], strict=True)):
                    cos[k, x:y] = -np.inf
                best, n = cos.argmax(1), np.isfinite(cos).sum(1)
                some = n > 0
                out.append((query[s][some], ids[best[some]], cos[np.flatnonzero(some), best[some]], n[some]))
        held = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[], [], [], []]
        types = (asked.schema.field("query").type, rows.schema.field("id").type, pa.float64(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(held, types, strict=True)], names=["query", "id", "cosine", "c"])

    held = kept(rows.mapInArrow(placed, f"id {kind}, asked boolean, v array<double>, pivot long, r double"))
    asked = held.where("asked").select(F.col("id").alias("query"), F.col("v").alias("q"), F.col("pivot").alias("own"))
    best = F.max(F.struct(F.round("cosine", COSINE_DECIMALS).alias("cosine"), (-F.col("id")).alias("_id")))
    spans = kept(held.groupBy("pivot").agg(F.min("r").alias("_near"), F.max("r").alias("_far"), F.ceil(F.count("*") / ROWS).alias("_parts")))

    def compared(pairs: DataFrame) -> DataFrame:
        """query, b, c of queries (query, q, pivot, d, _reach) and the rows of their pivots, which are dealt in parts of about ``ROWS``."""
        parts = spans.select("pivot", "_parts")
        a = pairs.join(parts, "pivot").select("query", "q", "pivot", "d", "_reach", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part"))
        b = held.join(parts, "pivot").select("id", "v", "r", "pivot", F.pmod(F.xxhash64("id"), "_parts").alias("part"))
        met = a.groupBy("pivot", "part").cogroup(b.groupBy("pivot", "part")).applyInArrow(look, f"query {kind}, id {kind}, cosine double, c long")
        return met.groupBy("query").agg(best.alias("b"), F.sum("c").alias("c"))

    nothing = F.lit(None).cast("double")
    first = kept(compared(asked.select("query", "q", F.col("own").alias("pivot"), F.lit(0.0).alias("d"), nothing.alias("_reach"))))
    # room for rounded cosines, which tie when they differ by less than a unit of the last decimal
    reach = first.select("query", F.sqrt(F.greatest(2 - 2 * F.col("b.cosine"), F.lit(0.0)) + 4 * 10.0**-COSINE_DECIMALS).alias("_reach"))
    gaps = asked.select("query", F.col("q").alias("v")).mapInArrow(far, f"query {kind}, pivot long, d double").join(spans, "pivot")
    open_ = gaps.join(asked.select("query", "own"), "query").where("pivot <> own").join(reach, "query", "left")
    open_ = open_.where(F.col("_reach").isNull() | ((F.col("d") - F.col("_far") <= F.col("_reach")) & (F.col("_near") - F.col("d") <= F.col("_reach"))))
    more = compared(open_.select("query", "pivot", "d", "_reach").join(asked.select("query", "q"), "query"))
    found = more.unionByName(first).groupBy("query").agg(F.max("b").alias("b"), F.sum("c").alias("compared"))
    return found.select("query", (-F.col("b._id")).alias("id"), F.col("b.cosine").alias("cosine"), "compared")


def similar_names(names: DataFrame, name: str, queries: DataFrame, query: str, least: float = 0.75) -> DataFrame:
    """query, name, edits: pairs of distinct strings that a ratio of ``least`` by matching blocks (2 M over both lengths) may join.

    With M matched characters at most s - 2 M are inserted or deleted, s being the sum of both lengths. The blocks are then s - 2 M + 1 at
    most, and hold M less so many neighbouring pairs of characters that stand in both strings. A pair of strings that share T of a query's
    pairs (counted as often as they occur) share one of all but T - 1 of them, the rarest ones, so these are joined by equality; the count, and the
    edit distance, are checked on what meets. Strings too short for T >= 1 meet by length, with its own bound.
    """
    a = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    b = queries.select(F.col(query).alias("query")).where("query IS NOT NULL").distinct()
    pieces = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    counted = lambda c: F.transform(pieces(c), lambda x, i: F.concat(x, F.size(F.filter(F.slice(pieces(c), F.lit(1), i + 1), lambda y: y == x)).cast("string")))
    held = kept(a.select("name", counted(F.col("name")).alias("g")))
    asked = kept(b.select("query", counted(F.col("query")).alias("h")))
    listed = held.select("name", F.length("name").alias("n"), F.explode("g").alias("m"))
    often = listed.groupBy("m").agg(F.count("*").alias("f"))
    m = F.length("query")
    # the shortest partner has the least T: its length is at least m * least / (2 - least)
    shortest = m + F.ceil(m * F.lit(least / (2 - least)) - 1e-9)
    fewest = lambda s: F.greatest(F.ceil(F.lit(least / 2) * s - 1e-9) - (F.floor(F.lit(1 - least) * s + 1e-9) + 1), F.lit(0))
    terms = asked.select("query", fewest(shortest).alias("t"), F.explode("h").alias("m"), F.size("h").alias("size")).join(often, "m", "left")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("f", F.lit(0)), "m"))
    prefix = terms.withColumn("k", place).where("t >= 1 AND k <= size - t + 1 AND f IS NOT NULL")
    met = prefix.select("query", "m").join(listed, "m").select("query", "name").distinct()
    short = asked.where(fewest(shortest) < 1).select("query", F.explode(F.sequence(F.ceil(m * least / (2 - least) - 1e-9).cast("int"), F.floor(m * (2 - least) / least + 1e-9).cast("int"))).alias("n"))
    met = met.unionByName(short.join(held.select("name", F.length("name").alias("n")), "n").select("query", "name"))
    s = F.length("name") + F.length("query")
    full = met.join(held, "name").join(asked, "query").where(F.size(F.array_intersect("g", "h")) >= fewest(s))
    edits = F.levenshtein("name", "query")
    return full.select("query", "name", edits.alias("edits")).where(F.col("edits") <= F.lit(1 - least) * (F.length("name") + F.length("query")) + 1e-9)
