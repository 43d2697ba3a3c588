"""Checks of tables: counts, keys, ranges, profiles. Each is a DataFrame with one row for each finding or measure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """name, rows of every table."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n, df in tables.items()])


def dangling(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key the parent lacks; null keys are none."""
    return df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur twice or more, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def parity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """rows_a, rows_b, missing_in_a, missing_in_b, same."""
    j = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    m = j.agg(F.count_if(F.col("_a").isNull()).alias("missing_in_a"), F.count_if(F.col("_b").isNull()).alias("missing_in_b"))
    return a.agg(F.count("*").alias("rows_a")).crossJoin(b.agg(F.count("*").alias("rows_b"))).crossJoin(m).withColumn("same", (F.col("missing_in_a") == 0) & (F.col("missing_in_b") == 0))


def rules(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """name, violations, rows: how many rows break each rule, in one pass."""
    row = df.agg(F.count("*").alias("rows"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(f"_{i}") for i, c in enumerate(checks.values())))
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"_{i}").alias("violations")) for i, n in enumerate(checks)))
    return row.select(F.explode(pairs).alias("c"), "rows").select("c.name", "c.violations", "rows")


def profile(df: DataFrame, samples: int = 5) -> DataFrame:
    """name, n_unique, n_null, least, most and samples (the smallest distinct values) of every column, in one pass over each."""
    out = []
    for c in df.columns:
        v = df.groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
        first = v.where("v IS NOT NULL").orderBy("v").limit(samples).agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("samples"))
        out.append(v.agg(F.lit(c).alias("name"), F.count("v").alias("n_unique"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.min("v").alias("least"), F.max("v").alias("most")).crossJoin(F.broadcast(first)))
    return reduce(DataFrame.unionByName, out)


def text_profile(df: DataFrame, columns: Sequence[str], long: int) -> DataFrame:
    """name, missing (null or blank), long (more characters than the limit)."""
    row = df.agg(*(F.count_if(F.coalesce(F.trim(c), F.lit("")) == "").alias(f"m_{c}") for c in columns), *(F.count_if(F.length(c) > long).alias(f"l_{c}") for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"m_{c}").alias("missing"), F.col(f"l_{c}").alias("long")) for c in columns))).alias("x")).select("x.*")


def schema_report(df: DataFrame, required: Mapping[str, str]) -> list[tuple[str, str]]:
    """(column, problem) of columns that are missing or of another type."""
    have = dict(df.dtypes)
    return [(c, "missing" if c not in have else f"is {have[c]}") for c, kind in required.items() if have.get(c) != kind]


def readiness(df: DataFrame, key: str, covered: Sequence[str], least: float) -> DataFrame:
    """rows, unique, each column's share of values, ready (has rows, and every share reaches ``least``)."""
    share = [F.avg(F.col(c).isNotNull().cast("double")).alias(f"coverage_{c}") for c in covered]
    out = df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("n_unique"), *share)
    return out.withColumn("ready", reduce(lambda a, b: a & b, [F.col(f"coverage_{c}") >= least for c in covered], F.col("rows") > 0))
