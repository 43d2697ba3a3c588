"""Joins, keyed merges and set operations beyond a plain join; what is broadcast is so by Spark's own size checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], *order: Column) -> DataFrame:
    """Left join with one row of the right side for each key, so rows never multiply."""
    return left.join(first_by(right, on, *order), list(on), "left")


#: Parts into which the rows of one key are dealt before they meet, so that a hot key is no single task.
DEALT = 8


def _pairs_once(left: DataFrame, lefts: Sequence[str], right: DataFrame, rights: Sequence[str], terms: str, dealt: int = DEALT) -> DataFrame:
    """lefts, rights: distinct pairs of rows that share one of their ``terms`` (an array, in an order that both sides have in common).

    Rows that agree in their columns are put together first. A pair then meets under each term both have, and is given for the first of them only;
    so pairs, of which there may be a product of both sides, are neither shuffled nor held.
    """

    def of(df: DataFrame, columns: Sequence[str], side: str) -> DataFrame:
        one = df.select(*(F.col(c).alias(f"{side}{i}") for i, c in enumerate(columns)), F.explode(terms).alias("_t")).where("_t IS NOT NULL").groupBy(*(f"{side}{i}" for i in range(len(columns)))).agg(F.sort_array(F.collect_set("_t")).alias("_all"))
        return one.select("*", F.posexplode("_all").alias("_at", "_t")).withColumn(f"{side}before", F.slice("_all", F.lit(1), F.col("_at"))).drop("_all", "_at")

    a = of(left, lefts, "_a").withColumn("_s", F.pmod(F.xxhash64(*(f"_a{i}" for i in range(len(lefts)))), F.lit(dealt)))
    b = of(right, rights, "_b").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1)).cast("array<bigint>")))
    met = a.join(b, ["_t", "_s"]).where((F.size("_abefore") == 0) | (F.size("_bbefore") == 0) | ~F.arrays_overlap("_abefore", "_bbefore"))
    return met.select(*(F.col(f"_a{i}").alias(c) for i, c in enumerate(lefts)), *(F.col(f"_b{i}").alias(c) for i, c in enumerate(rights)))


def _tagged(keys: Sequence[Column]) -> Column:
    """The values of several keys as one array of terms; later keys come first, and values of different keys differ."""
    tag = lambda i, k: F.when(k.isNotNull(), F.struct(F.lit(-i).alias("key"), k.cast("string").alias("value")))
    return F.filter(F.array(*(tag(i, k) for i, k in enumerate(keys))), lambda x: x.isNotNull())


def either_key_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[Column, Column]], left_columns: Sequence[str], right_columns: Sequence[str]) -> DataFrame:
    """Distinct pairs of rows that meet under any of the keys, compared as text: equi joins in the place of one condition with OR. No distinct over the pairs."""
    a, b = (df.select(*columns, _tagged([k[side] for k in keys]).alias("_terms")) for df, columns, side in ((left, left_columns, 0), (right, right_columns, 1)))
    return _pairs_once(a, left_columns, b, right_columns, "_terms")


def staged_match(left: DataFrame, stages: Sequence[tuple[str, DataFrame, str]], key: str, value: str) -> DataFrame:
    """key, value, stage: each stage (name, table, column of left) takes what the ones before it left unmatched."""
    rest, out = left, []
    for name, table, column in stages:
        keyed = table.withColumnsRenamed({key: "_k", value: "_v"}).select("_k", "_v")
        hit = rest.join(keyed, F.col(column) == F.col("_k")).select(*left.columns, F.col("_v").alias(value), F.lit(name).alias("stage"))
        out.append(hit)
        rest = rest.join(keyed.select("_k").distinct(), F.col(column) == F.col("_k"), "left_anti")
    out.append(rest.select(*left.columns, F.lit(None).cast("string").alias(value), F.lit("unmatched").alias("stage")))
    return reduce(DataFrame.unionByName, out)


def terms_join(left: DataFrame, terms: Column, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of left with the right rows of any of their terms, once each; columns are those of either side."""
    rights = [c for c in columns if c not in left.columns]
    lefts = [c for c in columns if c in left.columns]
    return _pairs_once(left.select(*lefts, terms.alias("_terms")), lefts, right.select(*rights, F.array(key).alias("_terms")), rights, "_terms").select(*columns)


def _by_rarest(keys: DataFrame, sought: DataFrame) -> DataFrame:
    """_id, _sought: rows of keys (_id, _key) that have the rarest key of each _sought (_sought, _key), if they have all of its keys at all.

    Only keys are exploded and shuffled. A key that a third of all rows have is nobody's rarest, unless there is none other.
    """
    often = keys.groupBy("_key").agg(F.count("*").alias("_f"))
    known = sought.distinct().join(often, "_key", "left").groupBy("_sought").agg(F.min(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), "_key")).alias("m"))
    return keys.join(known.where("m.f > 0").select("_sought", F.col("m._key").alias("_key")), "_key").select("_id", "_sought")


def token_contains_join(left: DataFrame, left_text: str, right: DataFrame, phrase: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose text holds the phrase between word borders.

    A text meets a phrase by the phrase's rarest word, by equality; texts are fetched for what has met, and compared. No nested loop.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")
    a = kept(left.withColumn("_id", F.monotonically_increasing_id()).withColumn("_text", F.array_join(words(left_text), " ")))
    b = right.withColumn("_sought", F.array_join(words(phrase), " ")).where("_sought <> ''")
    keys = a.select("_id", F.explode(F.array_distinct(F.split("_text", " "))).alias("_key"))
    met = _by_rarest(keys, b.select("_sought", F.explode(F.split("_sought", " ")).alias("_key")))
    space = F.lit(" ")
    held = met.join(a, "_id").where(F.concat(space, "_text", space).contains(F.concat(space, "_sought", space)))
    return held.join(b, "_sought").select(*columns).distinct()


def contains_join(whole: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """text, part: pairs of which the text contains the part, met by the part's rarest three characters. Empty parts are left out."""

    def of(c: str, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))

    a = kept(whole.select(text).withColumn("_id", F.monotonically_increasing_id()))
    keys = a.select("_id", F.explode(F.array_distinct(F.concat(of(text, 1), of(text, 2), of(text, 3)))).alias("_key"))
    b = parts.where(F.length(part) > 0).select(F.col(part).alias("_sought"))
    met = _by_rarest(keys, b.select("_sought", F.explode(F.when(F.length("_sought") < 3, F.array("_sought")).otherwise(of("_sought", 3))).alias("_key")))
    return met.join(a, "_id").where(F.col(text).contains(F.col("_sought"))).join(b, "_sought").select(text, F.col("_sought").alias(part))


def set_sizes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of the key sets: only_left, both, only_right; one full join of distinct keys."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, key, "full")
    return j.agg(F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_a").isNull()).alias("only_right"))


def merge_lists(df: DataFrame, key: str, order: str, lists: Sequence[str], firsts: Sequence[str], separator: str = "|") -> DataFrame:
    """A row for each key: the first row's attributes, and each list column's distinct terms in order of appearance."""
    out = df.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in firsts))
    for c in lists:
        terms = df.select(key, order, F.posexplode(F.split(c, F.lit(f"[{separator}]"))).alias("_p", "_t")).withColumn("_t", F.trim("_t")).where("_t <> ''")
        once = terms.groupBy(key, "_t").agg(F.min(F.struct(order, "_p")).alias("_o"))
        joined = once.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]), separator).alias(c))
        out = out.join(joined, key, "left")
    return out


def greedy_select(df: DataFrame, order: Sequence[tuple[str, bool]], key: str, k: int, eligible: Column) -> DataFrame:
    """Every row with action select, skip_duplicate, skip_missing or not_reached, as a walk down the order would decide until k are selected.

    The walk stops at the k-th pick. On the way, a row whose key was picked before is a duplicate, whether it is eligible or
    not; any other row that is not eligible is missing. order: columns, each with True for descending; null comes last, and no two rows are equal in all of them.
    The picks are found by key, and the k-th of them is one row that all others are compared with.
    """
    by = [(F.desc_nulls_last if down else F.asc_nulls_last)(c) for c, down in order]
    before = Window.partitionBy(key).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_ok", F.coalesce(eligible, F.lit(False)))
    rows = rows.withColumn("_seen", F.coalesce(F.max("_ok").over(before), F.lit(False)))
    first = rows.where("_ok AND NOT _seen").orderBy(*by).offset(k - 1).limit(1)
    last = first.agg(F.count("*").alias("_full"), *(F.max(c).alias(f"_last_{c}") for c, _ in order))  # one row, also where less than k are selected
    behind = F.lit(False)
    for c, down in reversed(order):
        here, end = F.col(c), F.col(f"_last_{c}")
        later = here.isNull() & end.isNotNull() | F.coalesce(here < end if down else here > end, F.lit(False))
        behind = later | here.eqNullSafe(end) & behind
    action = F.when((F.col("_full") > 0) & behind, "not_reached").when(F.col("_seen"), "skip_duplicate").when(~F.col("_ok"), "skip_missing").otherwise("select")
    return rows.crossJoin(F.broadcast(last)).withColumn("action", action).drop("_ok", "_seen", "_full", *(f"_last_{c}" for c, _ in order))


def when_chain(rules: Sequence[tuple[Column, object]], otherwise: object, last_wins: bool = False) -> Column:
    """An ordered ladder of rules; last_wins: rules that overwrite each other in sequence."""
    out = None
    for cond, value in reversed(rules) if last_wins else rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def coalesce_text(*names: str) -> Callable[[DataFrame], Column]:
    """The first of the named columns that exists and is not blank, names in any case."""

    def of(df: DataFrame) -> Column:
        by = {c.lower(): c for c in df.columns}
        held = [F.nullif(F.trim(F.col(by[n.lower()]).cast("string")), F.lit("")) for n in names if n.lower() in by]
        return F.coalesce(*held, F.lit("")) if held else F.lit("")

    return of


def first_existing_column(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of the names that df has, in any case."""
    by = {c.lower(): c for c in df.columns}
    return next((by[n.lower()] for n in names if n.lower() in by), None)


def key_column(df: DataFrame, names: Sequence[str], part: str) -> str:
    """A column by one of these names, else the first whose name holds the part, else the first."""
    return first_existing_column(df, names) or next((c for c in df.columns if part.lower() in c.lower()), df.columns[0])


def best_filled_column(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of the columns with any real value; one aggregate over all of them."""
    held = [n for n in names if n in df.columns]
    if not held:
        return None
    row = df.agg(*(F.count_if(F.col(n).isNotNull() & ~F.lower(F.trim(F.col(n).cast("string"))).isin("", "nan", "none")).alias(n) for n in held)).first()
    return next((n for n in held if row[n]), None)


def shaped(df: DataFrame, rename: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Renamed, and with exactly these columns; those that are missing are empty text."""
    out = df.withColumnsRenamed(rename)
    return out.select(*(F.col(c) if c in out.columns else F.lit("").alias(c) for c in keep))


def numeric_columns(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns."""
    return [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal") and f.name not in but]


def search_columns(df: DataFrame, pattern: str) -> Column:
    """Any text column matches the pattern."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(f.name).rlike(pattern), F.lit(False)) for f in df.schema if f.dataType.typeName() == "string"])
