"""Operator 11: sources mixed to target weights, by whole documents whose sizes fit each source's budget.

* A document's size is its number of words. Sources in the order of their code points, null last, have the weights ``WEIGHTS``, repeated,
  and share all words; a target stops at ``MOST`` times its source's size, and what is above goes to the others by weight, until none is above.
* Documents are counted by source and exact size. A source's budget, the rounded target, first takes every document as many
  whole times as fits, then the same share of the documents of each size. One document more of some sizes, in an order by the seed,
  brings what remains below ``WINDOW`` words, and a bounded knapsack over sizes and the documents left of each fills it: a
  bit set of the sums that can be reached, size by size in that order, with the number of documents split in powers of two.
  The budget is met exactly where some sum meets it, else by the nearest sum.
* Of each size that many documents are chosen by rank of a seeded hash of doc_id. A crowded size is cut in ranges of the hash of
  about ``BUCKET`` documents each, whose counts tell which are taken whole, so ranks are only needed within a range.

What a task holds of one source is a count for each size, which are no more than the words of its longest document, nor than the root of
twice the source's words. Null text counts as empty and is never taken; null doc_id is an id like others; rows with one doc_id are
rows of their own. Sources without words have target 0. Other columns are dropped, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 11
#: Words that are left to the knapsack.
WINDOW = 1 << 14
#: Documents of a range of the hash, on average.
BUCKET = 1 << 10
_UNIT = 1 << 52


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source (never null), no_source (it was), size in words."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("no_source"), words.alias("size"))


def targets(counts: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """source, no_source, source_size, target from counts (source, no_source, size, n)."""
    keys = ["no_source", "source"]
    sums = counts.groupBy(*keys).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    placed = written(sums.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r.p, r.n) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before = dict(zip((p for p, _ in sizes), np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False)) or {0: 0}
    place = F.element_at(F.create_map(*(F.lit(v) for kv in before.items() for v in kv)), part.cast("int")) + F.col("_at").bitwiseAND((1 << 33) - 1)
    weighed = placed.select(*keys, "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).alias("_w"))
    all_words, all_weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    words, weight, stopped = share * all_words, all_weight, 0
    while True:  # each turn adds stopped sources, so few turns
        full = F.lit(float(most)) * F.col("source_size") * F.lit(float(weight)) <= F.lit(float(words)) * F.col("_w")
        n, size, w = weighed.where(full).agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
        if n == stopped or w == all_weight:
            break
        words, weight, stopped = share * all_words - most * size, all_weight - w, n
    level = F.lit(float(words)) * F.col("_w") / F.lit(float(max(weight, 1)))
    return weighed.select(*keys, "source_size", F.when(full, F.col("source_size") * float(most)).otherwise(level).alias("target"))


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many to take of each size, at most its count, for the sum nearest to the budget (of two the smaller)."""
    taken = np.zeros(len(sizes), np.int64)
    usable = np.flatnonzero((sizes > 0) & (counts > 0))
    if budget <= 0 or not len(usable):
        return taken
    top = budget + min(budget, int(sizes[usable].max()))
    mask, reached = (1 << top + 1) - 1, 1
    via = np.full(top + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i in usable.tolist():
        left, k = min(int(counts[i]), top // int(sizes[i])), 1
        while left and not reached >> budget & 1:
            k = min(k, left)
            new = (reached << k * int(sizes[i])) & mask & ~reached
            if new:
                bits = np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8)
                via[np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = len(items)
                reached |= new
            items.append((i, k))
            left, k = left - k, 2 * k
    sums = np.concatenate([[0], np.flatnonzero(via >= 0)])
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, k = items[via[at]]
        taken[i] += k
        at -= k * int(sizes[i])
    return taken


def fitted(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED, window: int = WINDOW) -> tuple[int, np.ndarray]:
    """How often all documents are taken, and how many of each size once more, for a sum near the budget."""
    order = np.random.default_rng(seed).permutation(len(sizes))[np.argsort(np.argsort(sizes, kind="stable"))]
    total = int(sum(int(s) * int(n) for s, n in zip(sizes, counts, strict=True)))
    if not total or budget <= 0:
        return 0, np.zeros(len(sizes), np.int64)
    whole, rest = divmod(budget, total)
    taken = np.array([int(n) * rest // total for n in counts], np.int64)
    taken[sizes == 0] = 0
    rest -= int(sum(int(s) * int(n) for s, n in zip(sizes, taken, strict=True)))
    turn = np.argsort(order, kind="stable")
    for i in turn.tolist():
        if rest <= window:
            break
        if counts[i] > taken[i] and 0 < sizes[i] <= rest:
            taken[i] += 1
            rest -= int(sizes[i])
    taken[turn] += knapsack(sizes[turn], (counts - taken)[turn], rest)
    return whole, taken


def budgets(counts: DataFrame, goals: DataFrame, seed: int = SEED) -> DataFrame:
    """source, no_source, size, n, source_size, target, whole (times all are taken), more (documents taken once more)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        whole, more = fitted(rows["size"].to_numpy(), rows["n"].to_numpy(), round(float(rows["target"].iloc[0])), seed)
        return rows.assign(whole=whole, more=more)

    both = counts.join(goals, ["source", "no_source"])
    return both.groupBy("source", "no_source").applyInPandas(run, "source string, no_source boolean, size long, n long, source_size long, target double, whole long, more long")


def chosen(rows: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """The columns of rows and plan, and copies: how often each document is taken."""
    keys = ["source", "no_source", "size"]
    r = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull()), F.lit(_UNIT))
    both = rows.join(plan, keys)
    some = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    alike = both.where(~some).withColumn("copies", F.col("whole") + F.when(F.col("more") > 0, 1).otherwise(0))
    bucket = F.floor(F.col("_r") / float(_UNIT) * F.ceil(F.col("n") / BUCKET)).cast("long")
    crowd = both.where(some).withColumn("_r", r).withColumn("_b", bucket)
    sizes = crowd.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_c")).drop("_c")
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_r", "doc_id"))
    split = crowd.withColumn("_rank", rank).join(before, [*keys, "_b"]).withColumn("copies", F.col("whole") + (F.col("_rank") + F.col("_before") <= F.col("more")).cast("long"))
    return alike.unionByName(split.select(*alike.columns))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words), copies of every document."""
    rows = written(measured(docs))
    counts = written(rows.groupBy("source", "no_source", "size").agg(F.count("*").alias("n")))
    plan = written(budgets(counts, targets(counts, weights, share, most), seed))
    out = chosen(rows, plan, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken; doc_id tells documents apart."""
    copies = mix(docs, **how).where("copies > 0").select(F.col("doc_id").alias("_id"), "copies")
    return docs.join(copies, F.col("doc_id") == F.col("_id")).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_id", "copies", "_")
