"""Composite scores, gates and overlaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import blend
from . import shared
from .stats import percentile_scores, percentiles


def top_k_rates(pairs: DataFrame, sample: str, entity: str, prediction: str, ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """entity, mean_pred, std_pred, n, and the share of its samples in which it ranks among the best k, lowest prediction first."""
    rank = F.rank().over(Window.partitionBy(sample).orderBy(F.col(prediction).asc_nulls_last()))
    ranked = pairs.withColumn("_r", rank)
    return ranked.groupBy(entity).agg(
        F.avg(prediction).alias("mean_pred"), F.stddev_samp(prediction).alias("std_pred"), F.count("*").alias("n"),
        *(F.avg((F.col("_r") <= k).cast("double")).alias(f"top{k}_rate") for k in ks),
    )


def composite(scores: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """scores with a percentile column for each weighted column (a leading '-' reverses it), and their blend as composite."""
    values = {f"pct_{name.lstrip('-')}": -F.col(name[1:]) if name.startswith("-") else F.col(name) for name in weights}
    return percentile_scores(shared.kept(scores), values).withColumn("composite", blend(dict(zip(values, weights.values(), strict=True))))


def gate_adjusted(score: Column, violations: Column, failed: Column, step: float = 0.04, fail: float = 0.25, missing: int = 3) -> Column:
    """The score less a step for each violation (unknown counts as ``missing``) and less ``fail`` for a failed gate."""
    return score - F.lit(step) * F.coalesce(violations, F.lit(missing)) - F.when(failed, F.lit(fail)).otherwise(F.lit(0.0))


def path_score(rank: Column, total: Column, passed: Column, evidences: Column, overlap: Column, hard: Column, soft: Column) -> tuple[Column, Column, Column]:
    """positive, penalty and score of a candidate from its rank, gate, evidence and overlap."""
    by_rank = F.when(total > 1, 1 - (rank - 1) / (total - 1)).otherwise(F.lit(1.0))
    positive = F.lit(0.30) * by_rank + F.lit(0.20) * F.when(passed, 1.0).otherwise(0.0) + F.lit(0.25) * F.least(evidences / F.lit(3.0), F.lit(1.0)) + F.lit(0.15) * overlap
    flag = lambda c, w: F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(F.lit(0.0))
    penalty = flag(hard, 0.25) + flag(~F.coalesce(passed, F.lit(False)), 0.10) + flag(soft, 0.05)
    return positive, penalty, F.greatest(F.lit(0.0), F.least(F.lit(1.0), positive - penalty))


def weighted_sum(values: DataFrame, entity: str, item: str, value: str, weights: DataFrame, base: float = 0.0) -> DataFrame:
    """entity, score: base and the sum of each item's value times its weight; weights has (item, weight), an item once."""
    return values.join(weights, item, "left").groupBy(entity).agg((F.lit(base) + F.sum(F.coalesce(F.col(value) * F.col("weight"), F.lit(0.0)))).alias("score"))


def set_links(left: DataFrame, right: DataFrame, left_id: str, right_id: str, term: str) -> DataFrame:
    """left_id, right_id, shared, left_size, right_size, jaccard of the sets that share a term.

    left and right have a row for each id and term. Pairs come from an equi join on the term; sets that share nothing are
    no row. A term of both sides that is in very many sets is the caller's to leave out by name.
    """
    a, b = left.select(left_id, term).distinct(), right.select(right_id, term).distinct()
    na, nb = a.groupBy(left_id).agg(F.count("*").alias("left_size")), b.groupBy(right_id).agg(F.count("*").alias("right_size"))
    shared = a.join(b, term).groupBy(left_id, right_id).agg(F.count("*").alias("shared"))
    out = shared.join(na, left_id).join(nb, right_id)
    return out.withColumn("jaccard", F.col("shared") / (F.col("left_size") + F.col("right_size") - F.col("shared")))


def grade(p: Column, jaccard: Column) -> Column:
    """A below 0.01, B below 0.05 or with any overlap, else C."""
    return F.when(p < 0.01, "A").when((p < 0.05) | (jaccard > 0), "B").otherwise("C")


def precision_at(df: DataFrame, rank: str, hit: Column, k: int) -> DataFrame:
    """k, hits, precision among the first k ranks."""
    return df.where(F.col(rank) <= k).agg(F.lit(k).alias("k"), F.count_if(hit).alias("hits"), F.avg(hit.cast("double")).alias("precision"))


def tercile_grade(df: DataFrame, value: str) -> DataFrame:
    """df with grade A (best third), B or C by the exact terciles of a column; the two numbers are joined as one row."""
    cuts = percentiles(df, value, (1 / 3, 2 / 3)).withColumnRenamed("q", "_q")
    return df.crossJoin(F.broadcast(cuts)).withColumn("grade", F.when(F.col(value) >= F.col("_q")[1], "A").when(F.col(value) >= F.col("_q")[0], "B").otherwise("C")).drop("_q")


def weighted_ensemble(models: DataFrame, key: str, model: str, prediction: str, quality: DataFrame, best: int = 3) -> DataFrame:
    """key, ensemble: predictions of the best models, weighted by their positive quality; equally if none has any."""
    top = quality.orderBy(F.desc("quality"), model).limit(best).withColumn("_w", F.greatest("quality", F.lit(0.0)))
    total = F.sum("_w").over(Window.partitionBy(F.lit(1)))
    top = top.withColumn("weight", F.when(total < 1e-9, F.lit(1.0) / F.count("*").over(Window.partitionBy(F.lit(1)))).otherwise(F.col("_w") / total)).select(model, "weight")
    return models.join(top, model).groupBy(key).agg(F.sum(F.col(prediction) * F.col("weight")).alias("ensemble"))


def folds(key: Column, k: int) -> Column:
    """The fold of a group key; rows of a group share it."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(k)).cast("int")
