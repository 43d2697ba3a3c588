"""Statistics as DataFrames, and the tails of their distributions.

Every statistic is an aggregate over all rows. A p-value is computed from a few numbers for each test, by the small
functions at the end; they run on the driver or, for tables of many tests, in a pandas UDF.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, rho: Pearson's correlation of average ranks. The ranks come from counts of distinct values, so ties cost nothing."""
    held = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ranks = ranked_values(held, ["x", "y"])
    for k, c in enumerate("xy"):
        held = held.join(ranks.where(F.col("k") == k).select(F.col("v").alias(c), F.col("rank").alias(f"rank_{c}")), c)
    return held.agg(F.count("*").alias("n"), F.corr("rank_x", "rank_y").alias("rho"))


def ranked_values(df: DataFrame, columns: Sequence[str], ties: str = "average") -> DataFrame:
    """k (place of the column), v, rank, n (rows): the rank of each distinct number of each column, from 1.

    Equal values share the mean or, by ties='least', the least of their ranks. All columns go together: values are counted, dealt out to
    ranges of (column, value) and summed up by range; a range adds the sums of those before it, of which there are as many as partitions. Nulls have no rank.
    """
    stacked = df.select(F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("k", "v")).where("v IS NOT NULL")
    counts = stacked.groupBy("k", "v").agg(F.count("*").alias("n"))
    placed = kept(counts.repartitionByRange("k", "v").select("*", F.spark_partition_id().alias("_range")))
    sums = placed.groupBy("k", "_range").agg(F.sum("n").alias("_sum"))
    before = sums.select("k", "_range", (F.sum("_sum").over(Window.partitionBy("k").orderBy("_range")) - F.col("_sum")).alias("_before"))
    below = F.sum("n").over(Window.partitionBy("k", "_range").orderBy("v")) - F.col("n") + F.col("_before")
    rank = below + ((F.col("n") + 1) / F.lit(2.0) if ties == "average" else F.lit(1))
    return placed.join(F.broadcast(before), ["k", "_range"]).select("k", "v", rank.alias("rank"), "n")  # before has a row for each partition and column


def percentiles(df: DataFrame, c: str, levels: Sequence[float]) -> DataFrame:
    """q: one row with the exact percentiles of a number, interpolated; null where there are no rows.

    Values are counted and ranked by ranges (``ranked_values``), so no task sees the whole column. The values at the places beside each level are looked up by their ranks.
    """
    ranks = ranked_values(df, [c], "least").select("v", F.col("rank").alias("r"), "n")
    n = ranks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()[0]
    places = [(n - 1) * x for x in levels]
    at = lambda place: F.max(F.when((F.col("r") <= place + 1) & (F.col("r") + F.col("n") > place + 1), F.col("v")))
    parts = []
    for p in places if n else []:
        low, high = math.floor(p), math.ceil(p)
        parts.append(at(low) if low == high else at(low) * (high - p) + at(high) * (p - low))
    return ranks.agg(F.array(*(parts or [F.lit(None).cast("double")] * len(levels))).alias("q"))


def rank_table(df: DataFrame, c: str, ties: str = "average") -> DataFrame:
    """The column's distinct numbers, and rank_ with their ranks."""
    return ranked_values(df, [c], ties).select(F.col("v").alias(c), F.col("rank").alias(f"rank_{c}"))


def percentile_scores(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """df with a column for each value: (average rank - 1) / (n - 1), 0.5 where all values are equal, null for null.

    The values are joined on, so the caller fixes computed ones first (``shared.kept``).
    """
    names = [f"_v{k}" for k in range(len(values))]
    df = df.withColumns({n: v.cast("double") for n, v in zip(names, values.values(), strict=True)})
    ranks = ranked_values(df, names)
    sizes = {r.k: r for r in ranks.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}  # a row for each value
    for k, (name, v) in enumerate(zip(values, names, strict=True)):
        if k not in sizes:
            df = df.withColumn(name, F.lit(None).cast("double"))
        elif sizes[k].kinds == 1:
            df = df.withColumn(name, F.when(F.col(v).isNotNull(), 0.5))
        else:
            own = ranks.where(F.col("k") == k).select(F.col("v").alias(v), ((F.col("rank") - 1) / (sizes[k].n - 1)).alias(name))
            df = df.join(own, v, "left")
    return df.drop(*names)


def errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """n, rmse, mae, r2, pearson."""
    e = F.col(actual) - F.col(predicted)
    return df.agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / (F.var_pop(actual) * F.count(actual))).alias("r2"), F.corr(actual, predicted).alias("pearson"),
    )


def signed_pairs(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> float:
    """The sum of sign(y - y') * c * c' over all pairs with x' < x, for distinct (x, y), by sorting: n log(n) ** 2 steps."""
    order = np.lexsort((y, x))
    x, c = x[order], c[order].astype(float)
    y = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    most, total, width, at = int(y.max(initial=0)) + 1, 0.0, 1, np.arange(len(y))
    while width < len(y):
        block, right = at // (2 * width), (at // width) % 2 == 1
        key = block * most + y
        left = np.flatnonzero(~right)
        left = left[np.argsort(key[left], kind="stable")]
        held, sums = key[left], np.concatenate([[0.0], np.cumsum(c[left])])
        of = np.flatnonzero(right)
        low, high = (sums[np.searchsorted(held, key[of], side)] for side in ("left", "right"))
        first, last = (sums[np.searchsorted(held, edge)] for edge in (block[of] * most, (block[of] + 1) * most))
        total += float((c[of] * ((low - first) - (last - high))).sum())
        width *= 2
    same = np.add.reduceat(c, np.flatnonzero(np.diff(x, prepend=np.nan) != 0)) if len(x) else c
    return total - float((same**2).sum() - (c**2).sum()) / 2  # pairs of equal x, which stand in the order of y


def ranges(cells: DataFrame, parts: int, out: str, *by: str) -> DataFrame:
    """cells with out, the range of their values that they fall in; ranges have about as many rows each."""
    return kept(cells.repartitionByRange(parts, *by).withColumn(out, F.spark_partition_id()))


def kendall(df: DataFrame, x: str, y: str, cells_of_range: int = 100_000) -> DataFrame:
    """n, tau_b from the table of distinct value pairs (cells).

    Cells are cut into ranges of (x, y), so a frequent x falls into several, and what each range holds of a y into ranges of y. Pairs of cells
    within a range of (x, y), pairs in different ones but within a range of y, and pairs in different ranges of both, which are as
    many rows as meetings of ranges, are each counted by sorting. Cells of one x in different ranges stand in the order of y; what
    they have been counted for is taken off again.
    """
    cells = kept(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c")))
    parts = max(2, -(-cells.count() // cells_of_range))
    placed = ranges(cells, parts, "a", "x", "y")
    beside = ranges(placed.groupBy(F.col("a").alias("x"), "y").agg(F.sum("c").alias("c")), parts, "b", "y")
    grid = beside.groupBy("x", F.col("b").alias("y")).agg(F.sum("c").alias("c"))

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [signed_pairs(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["c"].to_numpy())]})

    by = lambda rows, *key: rows.groupBy(*key).applyInPandas(counted, "s double")
    same = placed.groupBy("x", "a").agg(F.sum("c").cast("double").alias("t")).groupBy("x").agg((F.sum(F.col("t") * F.col("t")) - F.sum("t") * F.sum("t")).alias("s"))
    all_s = by(placed, "a").unionByName(by(beside, "b")).unionByName(by(grid, F.lit(0).alias("_"))).unionByName(same.select((F.col("s") / 2).alias("s")))
    s = all_s.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    ties = lambda c: cells.groupBy(c).agg(F.sum("c").alias("t")).agg(F.coalesce(F.sum(F.col("t") * (F.col("t") - 1) / 2), F.lit(0.0)).alias(f"t{c}"))
    n = cells.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    j = s.crossJoin(ties("x")).crossJoin(ties("y")).crossJoin(n)  # one row each
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return j.select("n", (F.col("s") / F.nullif(F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty"))), F.lit(0.0))).alias("tau_b"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, observed, expected for every cell of the table, empty ones too."""
    held = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = held.groupBy(a, b).agg(F.count("*").alias("observed"))
    rows, columns = cells.groupBy(a).agg(F.sum("observed").alias("_r")), cells.groupBy(b).agg(F.sum("observed").alias("_c"))
    total = cells.agg(F.sum("observed").alias("_n"))
    full = rows.crossJoin(columns).crossJoin(total).join(cells, [a, b], "left")  # categories only, one row each
    return full.select(a, b, F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("_r") * F.col("_c") / F.col("_n")).alias("expected"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """statistic, dof; with Yates's correction where dof is 1."""
    t = contingency(df, a, b)
    size = t.agg(((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("dof"))
    gap = F.abs(F.col("observed") - F.col("expected"))
    gap = F.when(F.col("dof") == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    return t.crossJoin(size).groupBy("dof").agg(F.sum(gap * gap / F.col("expected")).alias("statistic"))


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, mean, var (of the sample)."""
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """f, df_between, df_within."""
    m = group_moments(df, group, value)
    t = m.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"), F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("w"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return t.select((between / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def welch(df: DataFrame, group: str, value: str, a: object, b: object) -> DataFrame:
    """t, dof for two groups."""
    m = group_moments(df.where(F.col(group).isin(a, b)), group, value)
    pick = lambda g, c: F.max(F.when(F.col(group) == F.lit(g), F.col(c)))
    t = m.agg(*(pick(g, c).alias(f"{c}{i}") for i, g in enumerate((a, b)) for c in ("n", "mean", "var")))
    e0, e1 = F.col("var0") / F.col("n0"), F.col("var1") / F.col("n1")
    return t.select(((F.col("mean0") - F.col("mean1")) / F.sqrt(e0 + e1)).alias("t"), ((e0 + e1) * (e0 + e1) / (e0 * e0 / (F.col("n0") - 1) + e1 * e1 / (F.col("n1") - 1))).alias("dof"))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """h (corrected for ties), dof."""
    held = df.where(F.col(value).isNotNull()).select(group, F.col(value).alias("v"))
    ranked = held.join(rank_table(held, "v"), "v")
    sums = ranked.groupBy(group).agg(F.sum("rank_v").alias("r"), F.count("*").alias("n")).agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), F.sum("n").alias("n"), (F.count("*") - 1).alias("dof"))
    ties = held.groupBy("v").agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    return sums.crossJoin(ties).select((h / (1 - F.col("ties") / (n * n * n - n))).alias("h"), "dof")


def mann_whitney(df: DataFrame, group: str, value: str, a: object, b: object) -> DataFrame:
    """u (of group a), n1, n2."""
    held = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(group, F.col(value).alias("v"))
    r = held.join(rank_table(held, "v"), "v")
    is_a = F.col(group) == F.lit(a)
    t = r.agg(F.sum(F.when(is_a, F.col("rank_v"))).alias("s"), F.count_if(is_a).alias("n1"), F.count_if(~is_a).alias("n2"))
    return t.select((F.col("s") - F.col("n1") * (F.col("n1") + 1) / F.lit(2.0)).alias("u"), "n1", "n2")


def running(placed: DataFrame, by: Sequence[str], range_: str, order: str, value: Column, out: str) -> DataFrame:
    """placed with out, the sum of value over the rows up to each in the order of ``order``, in each group.

    placed is cut into ranges of (by, order); a range adds up its own rows, and the sums of the ranges before it, of which there are as many as
    partitions and groups that meet in them.
    """
    sums = placed.groupBy(*by, range_).agg(F.sum(value).alias("_sum"))
    past = F.sum("_sum").over(Window.partitionBy(*by).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(by)), F.col(range_).alias("_range"), F.coalesce(past, F.lit(0)).alias("_before"))
    local = placed.withColumn(out, F.sum(value).over(Window.partitionBy(*by, range_).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    meet = F.col(range_) == F.col("_range")
    for i, c in enumerate(by):
        meet &= F.col(c).eqNullSafe(F.col(f"_{i}"))
    return local.join(before, meet).withColumn(out, F.col(out) + F.col("_before")).select(*placed.columns, out)


def kaplan_meier(df: DataFrame, time: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """time, at_risk, events, survival at each time with an event. Rows shrink to one for each time, and times are cut into ranges; no task sees them all."""
    t = df.groupBy(*by, F.col(time).alias("time")).agg(F.count("*").alias("_n"), F.sum(F.col(event).cast("int")).alias("events"))
    placed = kept(t.repartitionByRange(*by, "time").withColumn("_at", F.spark_partition_id()))
    known = running(placed, by, "_at", "time", F.col("_n"), "_gone")
    total = placed.groupBy(*by).agg(F.sum("_n").alias("_all")).select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(by)), "_all")
    meet = F.lit(True)
    for i, c in enumerate(by):
        meet &= F.col(c).eqNullSafe(F.col(f"_{i}"))
    known = (known.join(total, meet) if by else known.crossJoin(F.broadcast(total))).withColumn("at_risk", F.col("_all") - F.col("_gone") + F.col("_n")).where("events > 0")  # one row without groups
    factor = F.when(F.col("events") == F.col("at_risk"), F.lit(float("-inf"))).otherwise(F.log(1 - F.col("events") / F.col("at_risk")))
    out = running(known.select(*by, "time", "_at", "at_risk", "events"), by, "_at", "time", factor, "_log")
    return out.select(*by, "time", "at_risk", "events", F.exp("_log").alias("survival"))


def log_rank_table(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """group, observed, expected, the parts of the log-rank test; its covariance follows from ``log_rank``."""
    cells = df.groupBy(F.col(time).alias("time"), F.col(group).alias("g")).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("int")).alias("d"))
    groups = cells.select("g").distinct()
    grid = cells.select("time").distinct().crossJoin(groups).join(cells, ["time", "g"], "left").na.fill(0, ["n", "d"])
    risk = F.sum("n").over(Window.partitionBy("g").orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0))
    at = Window.partitionBy("time")
    grid = grid.withColumn("r", risk)  # names differ in more than their case, which Spark does not tell apart
    return grid.select("time", "g", "d", "r", F.sum("r").over(at).alias("risk_all"), F.sum("d").over(at).alias("events_all"))


def log_rank(df: DataFrame, time: str, event: str, group: str) -> tuple[float, int]:
    """Statistic and dof over any number of groups; only sums by group and pair of groups reach the driver."""
    t = log_rank_table(df, time, event, group).where("risk_all > 1 AND events_all > 0")
    e = t.groupBy("g").agg(F.sum(F.col("d") - F.col("events_all") * F.col("r") / F.col("risk_all")).alias("z")).orderBy("g").collect()
    f = F.col("a.events_all") * (F.col("a.risk_all") - F.col("a.events_all")) / (F.col("a.risk_all") * F.col("a.risk_all") * (F.col("a.risk_all") - 1))
    own = F.when(F.col("a.g") == F.col("b.g"), F.col("a.r") * F.col("a.risk_all")).otherwise(0) - F.col("a.r") * F.col("b.r")
    v = {(r.x, r.y): r.v for r in t.alias("a").join(t.alias("b"), F.col("a.time") == F.col("b.time")).groupBy(F.col("a.g").alias("x"), F.col("b.g").alias("y")).agg(F.sum(f * own).alias("v")).collect()}
    names = [r.g for r in e]
    if len(names) < 2:
        return 0.0, 0
    z = np.array([r.z for r in e][:-1], float)
    m = np.array([[v[a, b] for b in names[:-1]] for a in names[:-1]], float)
    return float(z @ np.linalg.pinv(m) @ z), len(names) - 1


def quantiles(df: DataFrame, column: str, levels: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear quantiles."""
    if not by:
        return percentiles(df, column, levels)
    return df.groupBy(*by).agg(F.percentile(column, F.array(*(F.lit(x) for x in levels))).alias("q"))


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * total:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    f, c, d, b = 1e300, 1e300, 0.0, x + 1 - a
    c, d = 1e300, 1 / b
    f = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        f *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return scale * f


def chi2_tail(x: float, dof: float) -> float:
    """P(chi-square >= x)."""
    return gamma_tail(dof / 2, x / 2)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 10_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            f *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * f


def t_tail(t: float, dof: float) -> float:
    """Two-sided P(|T| >= t)."""
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F >= f)."""
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


@functools.lru_cache(1 << 16)
def fisher_greater(a: int, b: int, c: int, d: int) -> float:
    """P(table at least as extreme, upper side) of the 2 by 2 table."""
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    r, s, n = a + b, a + c, a + b + c + d
    return min(1.0, sum(math.exp(log(r, k) + log(n - r, s - k) - log(n, s)) for k in range(a, min(r, s) + 1)))
