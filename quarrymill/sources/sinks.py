"""Writers, and the table changes of a database as new tables: upsert, update from a join, insert where missing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Overwrite a Parquet table, in folders by the columns given."""
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], separator: str = ",", gzip: bool = False) -> None:
    """Overwrite a text table with these columns in this order; columns that df lacks are empty, all others are left out."""
    held = [F.col(c).cast("string") if c in df.columns else F.lit("").alias(c) for c in columns]
    writer = df.select(*held).write.mode("overwrite").option("header", True).option("sep", separator).option("emptyValue", "")
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Overwrite a table of JSON lines."""
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, rows: int = 100) -> str:
    """A report table of the first rows."""
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(rows).collect())])


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new in the place of rows of old with their keys, and all others of both."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, F.desc("_new")).drop("_new")


def update_from(old: DataFrame, source: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """old with the source's values where the keys meet; the source has a key once."""
    s = source.select(*keys, *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_hit"))
    out = old.join(s, list(keys), "left")
    return out.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns))


def insert_missing(old: DataFrame, new: DataFrame, *keys: Sequence[str]) -> DataFrame:
    """old and the rows of new that meet it under none of the keys; several keys are several anti joins, so each one hashes."""
    rest = new
    for key in keys:
        rest = rest.join(old.select(*key).distinct(), list(key), "left_anti")
    return old.unionByName(rest, allowMissingColumns=True)


def replace_where(old: DataFrame, gone: Column, new: DataFrame) -> DataFrame:
    """old without the rows for which gone holds, and new: delete and rebuild."""
    return old.where(~F.coalesce(gone, F.lit(False))).unionByName(new)


def insert_returning(old: DataFrame, new: DataFrame, path: str) -> DataFrame:
    """Write old and new rows as the next version of a table; what was inserted comes back as it was written."""
    write_parquet(old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True), path)
    return old.sparkSession.read.parquet(path).where("_new").drop("_new")


def update_returning(old: DataFrame, which: Column, values: Mapping[str, Column], path: str) -> DataFrame:
    """Write old with new values in the rows for which the condition holds as the next version of a table; these rows come back as they were written."""
    hit = F.coalesce(which, F.lit(False))
    columns = [F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns]
    write_parquet(old.select(*columns, hit.alias("_new")), path)
    return old.sparkSession.read.parquet(path).where("_new").drop("_new")
