"""Operator 10: quality rules with risk-controlled thresholds, in DataFrame functions only.

Every document is measured: words, symbols, repeated lines, words in repeated 3-word windows, capitals and marks. A
document fails the base rule with fewer than 50 words or with more than half of its words in repeated windows. Beyond
it, each score below has a cutoff of its own in each stratum (language), learned from labelled documents:

* The labelled documents are halved by a hash of doc_id. The first half proposes cutoffs, quantiles of the score.
* The second half, the holdout, tests them, from the most lenient to stricter ones: a cutoff is certified while the
  exact binomial probability of so few rejected good documents, were the rate of false rejection ``RISK / rules``, is
  at most ``ERROR / (strata * rules)``. Testing in a fixed order needs no correction over cutoffs, Bonferroni's
  corrects over strata and rules. So with probability 1 - ``ERROR`` no stratum loses more than ``RISK`` of its good
  documents to the learned rules. A rule without a certified cutoff rejects nothing there.

Windows are told apart by 64-bit hashes of their three words. Null text counts as empty (no words: base failed). Null lang
is a stratum of its own; labels without doc_id or quality teach nothing, and of several labels of a document the best
counts. Every language is a stratum, however many there are; one without labels has no cutoffs. Rows are judged
one by one, so repeated rows get equal verdicts; the input's columns are kept, whatever their names, but those of the operator's results are
replaced. An empty table of documents gives an empty result, one of labels leaves the base rule alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import fresh, written

#: Good documents of a stratum that the learned rules may reject, and the probability of an error in that.
RISK = 0.05
ERROR = 0.05
LEAST_WORDS = 50
#: Levels of the proposed cutoffs, the most lenient first.
LEVELS = [1.0, 0.9995, 0.999, 0.998, 0.996, 0.99, 0.98, 0.97, 0.96, 0.95, 0.94, 0.93, 0.92, 0.91, 0.9, 0.88, 0.86, 0.84, 0.82, 0.8]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def scores() -> dict[str, Column]:
    """Scores by rule, higher for worse; each is certified on its own."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "capitals": F.col("n_capitals") / chars,
        "marks": F.col("n_marks") / words,
    }


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, also where lambdas inside refer to it."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more."""

    def of_windows(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of_placed(s: Column) -> Column:
            again = F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
            starts = F.sort_array(F.transform(again, lambda x: x["i"]))
            return bound(starts, lambda a: F.aggregate(F.transform(a, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1) - i, F.lit(3)))), F.lit(0), lambda t, x: t + x))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(bound(placed, of_placed))

    def of_words(w: Column) -> Column:
        n = F.greatest(F.size(w) - 2, F.lit(0))
        return bound(F.transform(F.slice(w, F.lit(1), n), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), of_windows)

    return bound(words, of_words)


def measure(docs: DataFrame) -> DataFrame:
    """docs with ``COUNTS``, all long; narrow, without a shuffle."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    removed = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    base = docs.drop(*COUNTS)
    w, x = fresh(base, "_words", "_lines")
    base = base.withColumns({w: words, x: lines})
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": removed(r"[#*$%&|<>]+"),
        "n_dup_lines": F.size(x) - F.size(F.array_distinct(x)),
        "n_repeat_words": _repeat_words(F.col(w)),
        "n_lines": F.size(x),
        "n_capitals": removed("[A-Z]+"),
        "n_marks": removed("[!?]+"),
    }
    return base.withColumns({k: v.cast("long") for k, v in counts.items()}).drop(w, x)


def _log_factorial(n: Column) -> Column:
    """Stirling's series for log(n!), exact to 1e-12 through a shift by 12."""
    x = n.cast("double") + 13
    shift = sum((F.log(n.cast("double") + i) for i in range(2, 13)), F.log(n.cast("double") + 1))
    return (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), or 1 where k >= n * p. Terms are summed downwards from k; what is left after the last is bounded by a geometric series."""
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    odds = (1 - p) / p
    ratio = lambda j: (k - j) * odds / (n - k + j + 1)
    steps = F.sequence(F.lit(0), F.least(k, F.lit(4000)).cast("int"))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    run = F.aggregate(steps, zero, lambda a, j: F.struct((a["term"] * ratio(j)).alias("term"), (a["sum"] + a["term"]).alias("sum")), lambda a: a["sum"] + a["term"] / (1 - F.least(ratio(F.lit(0)), F.lit(0.999999))))
    return F.when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * run))


def stratum_of(lang: Column) -> Column:
    """The stratum of a language, '=' and its name; null and the empty name are two."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("null"))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, rule, cutoff: the strictest certified cutoffs, null where there is none. Aggregates over all labels; the result has a row for each stratum and rule."""
    rules = scores()
    quality = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_quality"))
    rows = measured.select("doc_id", stratum_of(F.col("lang")).alias("stratum"), *(c.alias(r) for r, c in rules.items()))
    rows = rows.join(quality, rows.doc_id == quality._id).select("stratum", "_quality", (F.xxhash64("doc_id", F.lit("half")) % 2 == 0).alias("_proposes"), *rules)
    long = rows.select("stratum", "_quality", "_proposes", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in rules))).alias("_x")).select("stratum", "_quality", "_proposes", "_x.*")
    proposed = long.where("_proposes").groupBy("stratum", "rule").agg(F.percentile_approx("score", LEVELS, 10_000).alias("cuts"))
    held = long.where(~F.col("_proposes") & (F.col("_quality") == 1))
    # A score counts for every cutoff below it: one row for each document and rule, and sums over the levels.
    tests = held.join(proposed, ["stratum", "rule"]).groupBy("stratum", "rule", "cuts").agg(F.count("*").alias("n"), *(F.sum((F.col("score") > F.get("cuts", F.lit(i))).cast("long")).alias(f"k{i}") for i in range(len(LEVELS))))
    sizes = tests.agg(F.count_distinct("stratum").alias("_strata"))
    tests = tests.crossJoin(F.broadcast(sizes)).select("stratum", "rule", "n", "_strata", F.posexplode(F.arrays_zip(F.col("cuts").alias("cut"), F.array(*(f"k{i}" for i in range(len(LEVELS)))).alias("k"))).alias("_level", "_t")).select("stratum", "rule", "n", "_strata", "_level", F.col("_t.cut").alias("cut"), F.col("_t.k").alias("k"))
    passed = (binomial_tail(F.col("n"), F.col("k"), risk / len(rules)) <= F.lit(error) / (F.col("_strata") * len(rules))).cast("int")
    order = Window.partitionBy("stratum", "rule").orderBy("_level")
    sure = tests.withColumn("_ok", passed).withColumn("_ok", F.min("_ok").over(order)).where("_ok = 1").groupBy("stratum", "rule").agg(F.min("cut").alias("cutoff"))
    every = rows.select("stratum").distinct().select("stratum", F.explode(F.array(*map(F.lit, rules))).alias("rule"))
    return every.join(sure, ["stratum", "rule"], "full")


def judge(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """measured with base_failed, failed_rules and kept. cuts has a row for each stratum and rule; Spark sends them out if they are small, else both sides meet by stratum."""
    rules = scores()
    base = measured.drop("base_failed", "failed_rules", "kept")
    own, limits = fresh(base, "_own", "_limits")
    wide = cuts.groupBy("stratum").agg(F.struct(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in rules)).alias(limits))
    judged = base.join(wide.select(F.col("stratum").alias(own), limits), stratum_of(F.col("lang")) == F.col(own), "left")
    failed = F.array_compact(F.array(*(F.when(c > F.col(limits)[r], r) for r, c in rules.items())))
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = judged.withColumn("base_failed", base_failed).withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(own, limits)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with their counts and verdicts. Counts without texts are written for the cutoffs; the result measures its rows again, so no copy of the texts stays on disk."""
    narrow = written(measure(docs).select("doc_id", "lang", *COUNTS))
    return judge(measure(docs), written(cutoffs(narrow, labels)))
