"""Queries of scores, statistics, vectors and models (DS)."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import models, nearest, scoring, stats, triples, vectors, ward, wide
from ..operators.shared import kept
from ..sources.tables import load
from .registry import query


@query("SELECT p_partkey, round(p_retailprice / 1000 - 0.04 * coalesce(CASE WHEN p_partkey % 11 <> 0 THEN p_size % 4 END, 3) - CASE WHEN p_size > 45 THEN 0.25 ELSE 0 END, 6)::DOUBLE AS score FROM part")
def ds02_gate_adjusted(spark, d):
    v = F.when(F.col("p_partkey") % 11 != 0, F.col("p_size") % 4)
    return load(spark, d, "part").select("p_partkey", F.round(scoring.gate_adjusted(F.col("p_retailprice") / 1000, v, F.col("p_size") > 45), 6).alias("score"))


@query("SELECT user_id, round(5 + sum(coalesce(value * CASE event_type WHEN 'click' THEN 0.1 WHEN 'purchase' THEN 0.5 WHEN 'error' THEN -0.4 END, 0)), 4)::DOUBLE AS score FROM events GROUP BY 1")
def ds03_weighted_sum(spark, d):
    w = spark.createDataFrame([("click", 0.1), ("purchase", 0.5), ("error", -0.4)], "event_type string, weight double")
    return scoring.weighted_sum(load(spark, d, "events"), "user_id", "event_type", "value", w, 5.0).select("user_id", F.round("score", 4).alias("score"))


@query("SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN 0.5 WHEN event_type = 'error' THEN -0.3 ELSE 0.05 END), 4)::DOUBLE AS score FROM events GROUP BY 1")
def ds04_bonus_penalty(spark, d):
    points = F.when(F.col("event_type") == "purchase", F.lit(0.5)).when(F.col("event_type") == "error", F.lit(-0.3)).otherwise(F.lit(0.05))
    return load(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(points), 4).alias("score"))


@query("""WITH c AS (SELECT p_brand, p_partkey, rank() OVER w AS rk, count(*) OVER (PARTITION BY p_brand) AS n, p_size <= 30 AS ok, p_partkey % 5 AS ev, (p_partkey % 3) / 2.0 AS ov, p_size > 45 AS hard, p_size % 2 = 1 AS soft FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC)),
 s AS (SELECT *, 0.30 * CASE WHEN n > 1 THEN 1 - (rk - 1) / (n - 1)::DOUBLE ELSE 1 END + CASE WHEN ok THEN 0.20 ELSE 0 END + 0.25 * least(ev / 3.0, 1) + 0.15 * ov AS pos, CASE WHEN hard THEN 0.25 ELSE 0 END + CASE WHEN NOT ok THEN 0.10 ELSE 0 END + CASE WHEN soft THEN 0.05 ELSE 0 END AS pen FROM c)
 SELECT p_partkey, round(pos, 6)::DOUBLE AS positive, round(pen, 6)::DOUBLE AS penalty, round(greatest(0, least(1, pos - pen)), 6)::DOUBLE AS score FROM s""")
def ds05_path_score(spark, d):
    w = Window.partitionBy("p_brand")
    p = load(spark, d, "part").withColumn("rk", F.rank().over(w.orderBy(F.desc("p_retailprice")))).withColumn("n", F.count("*").over(w))
    k = F.col("p_partkey")
    pos, pen, score = scoring.path_score(F.col("rk"), F.col("n"), F.col("p_size") <= 30, k % 5, (k % 3) / F.lit(2.0), F.col("p_size") > 45, F.col("p_size") % 2 == 1)
    return p.select("p_partkey", F.round(pos, 6).alias("positive"), F.round(pen, 6).alias("penalty"), F.round(score, 6).alias("score"))


@query("SELECT p_partkey, round(0.4 / rank() OVER (PARTITION BY p_type ORDER BY p_retailprice) + 0.3 * p_size / 50.0 + 0.2 * least(p_retailprice / 1500, 1) + 0.1 * least(p_partkey / 1000.0, 1), 6)::DOUBLE AS score FROM part")
def ds06_objectives(spark, d):
    rank = F.rank().over(Window.partitionBy("p_type").orderBy("p_retailprice"))
    s = F.lit(0.4) / rank + F.lit(0.3) * F.col("p_size") / 50.0 + F.lit(0.2) * F.least(F.col("p_retailprice") / 1500, F.lit(1.0)) + F.lit(0.1) * F.least(F.col("p_partkey") / 1000.0, F.lit(1.0))
    return load(spark, d, "part").select("p_partkey", F.round(s, 6).alias("score"))


@query("SELECT p_partkey, round(2 * CAST(p_size > 30 AS INTEGER) + 1.5 * CAST(p_type = 'PROMO' AS INTEGER) + 2.5 * CAST(p_retailprice < 1200 AS INTEGER) + (p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 6)::DOUBLE AS score FROM part")
def ds07_validation_score(spark, d):
    p = load(spark, d, "part")
    span = p.agg(F.min("p_size").alias("a"), F.max("p_size").alias("b"))
    s = 2 * (F.col("p_size") > 30).cast("int") + F.lit(1.5) * (F.col("p_type") == "PROMO").cast("int") + F.lit(2.5) * (F.col("p_retailprice") < 1200).cast("int") + (F.col("p_size") - F.col("a")) / (F.col("b") - F.col("a"))
    return p.crossJoin(F.broadcast(span)).select("p_partkey", F.round(s, 6).alias("score"))




def _word_rows(spark, d):
    return load(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("term")).distinct()


def _set_links(spark, d, words):
    brands = load(spark, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("term")).distinct()
    out = scoring.set_links(words, brands, "p_partkey", "p_brand", "term")
    return out.select("p_partkey", "p_brand", "shared", F.round("jaccard", 6).alias("jaccard"))


@query("""WITH w AS (SELECT DISTINCT p_partkey AS k, unnest(string_split(p_name, ' ')) AS t FROM part), b AS (SELECT DISTINCT p_brand AS b, unnest(string_split(p_name, ' ')) AS t FROM part), na AS (SELECT k, count(*) AS n FROM w GROUP BY 1), nb AS (SELECT b, count(*) AS n FROM b GROUP BY 1)
 SELECT k AS p_partkey, b AS p_brand, count(*) AS shared, round(count(*) / (any_value(na.n) + any_value(nb.n) - count(*)), 6) AS jaccard FROM w JOIN b USING (t) JOIN na USING (k) JOIN nb USING (b) GROUP BY 1, 2""")
def ds08_set_links(spark, d):
    return _set_links(spark, d, _word_rows(spark, d))


@query()
def ds08_fisher_grades(spark, d):
    """p-value and grade of each link, by the hypergeometric tail in a pandas UDF; background 20,000."""
    links = ds08_set_links(spark, d).join(_word_rows(spark, d).groupBy("p_partkey").agg(F.count("*").alias("a")), "p_partkey")
    sizes = load(spark, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("term")).distinct().groupBy("p_brand").agg(F.count("*").alias("b"))
    p = models.fisher_udf()(F.col("shared"), F.col("a"), F.col("b"), F.lit(20000))
    return links.join(sizes, "p_brand").withColumn("p_value", p).withColumn("grade", scoring.grade(F.col("p_value"), F.col("jaccard")))


@query("""WITH f AS (SELECT p_partkey, list_distinct(list_transform(generate_series(1, length(p_name) - 1), lambda i: substr(lower(p_name), CAST(i AS INTEGER), 2))) AS g FROM part), q AS (SELECT p_partkey AS q, g AS h FROM f WHERE p_partkey % 100 = 0),
 s AS (SELECT q, p_partkey, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) AS t FROM f, q WHERE p_partkey <> q) SELECT q, round(max(t), 6) AS best, arg_max(p_partkey, (round(t, 9), -p_partkey)) AS p_partkey FROM s GROUP BY 1""")
def ds09_tanimoto(spark, d):
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("p_name") - 1), lambda i: F.substring(F.lower("p_name"), i, F.lit(2))))
    f = load(spark, d, "part").select("p_partkey", grams.alias("g"))
    near = nearest.nearest_sets(f, "p_partkey", "g", F.col("p_partkey") % 100 == 0)
    return near.select(F.col("query").alias("q"), F.round("tanimoto", 6).alias("best"), F.col("id").alias("p_partkey"))


@query("WITH s AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS t FROM part WHERE p_size < 5) SELECT p_partkey, count(t2.t) AS overlap FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) a LEFT JOIN s t2 ON t2.t = w GROUP BY 1")
def ds10_overlap(spark, d):
    words = load(spark, d, "part").select("p_partkey", "p_size", F.explode(F.split("p_name", " ")).alias("w"))
    s = words.where("p_size < 5").select(F.col("w").alias("t")).distinct()
    return words.select("p_partkey", "w").distinct().join(s, F.col("w") == F.col("t"), "left").groupBy("p_partkey").agg(F.count("t").alias("overlap"))


@query("SELECT p_brand, round(avg(l_quantity), 4)::DOUBLE AS mean, round(stddev_samp(l_quantity), 4)::DOUBLE AS std, round(median(l_quantity), 4)::DOUBLE AS median FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def ds11_signature(spark, d):
    j = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand").agg(*(F.round(f("l_quantity"), 4).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("median", F.median))))


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r")
def ds12_spearman(spark, d):
    return stats.spearman(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select("n", F.round("rho", 6).alias("rho"))


@query("SELECT count(*) AS n, round(sqrt(avg((l_quantity - y) ** 2)), 6) AS rmse, round(avg(abs(l_quantity - y)), 6) AS mae, round(1 - sum((l_quantity - y) ** 2) / (var_pop(l_quantity) * count(*)), 6) AS r2, round(corr(l_quantity, y), 6) AS pearson FROM (SELECT l_quantity, l_extendedprice / 1500 AS y FROM lineitem)")
def ds13_errors(spark, d):
    out = stats.errors(load(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1500), "l_quantity", "y")
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2", "pearson")))


@query("""WITH c AS (SELECT p_size AS x, p_partkey % 17 AS y, count(*)::DOUBLE AS c FROM part GROUP BY 1, 2), s AS (SELECT sum(sign(b.y - a.y) * a.c * b.c) AS s FROM c a JOIN c b ON a.x < b.x), tx AS (SELECT sum(t * (t - 1) / 2) AS v FROM (SELECT sum(c) AS t FROM c GROUP BY x)), ty AS (SELECT sum(t * (t - 1) / 2) AS v FROM (SELECT sum(c) AS t FROM c GROUP BY y)), n AS (SELECT sum(c) AS n FROM c)
 SELECT CAST(n AS BIGINT) AS n, round(s / sqrt((n * (n - 1) / 2 - tx.v) * (n * (n - 1) / 2 - ty.v)), 6) AS tau_b FROM s, tx, ty, n""")
def ds13_kendall(spark, d):
    p = load(spark, d, "part").withColumn("y", F.col("p_partkey") % 17)
    return stats.kendall(p, "p_size", "y").select("n", F.round("tau_b", 6).alias("tau_b"))


def _chi(a: str, b: str, table: str, yates: bool) -> str:
    gap = "greatest(abs(o - e) - 0.5, 0)" if yates else "(o - e)"
    return f"""WITH t AS (SELECT {a} AS a, {b} AS b FROM {table}), x AS (SELECT a, count(*) AS n FROM t GROUP BY 1), y AS (SELECT b, count(*) AS n FROM t GROUP BY 1), c AS (SELECT a, b, count(*) AS n FROM t GROUP BY 1, 2),
 f AS (SELECT coalesce(c.n, 0) AS o, x.n * y.n / (SELECT count(*) FROM t)::DOUBLE AS e FROM x CROSS JOIN y LEFT JOIN c ON c.a = x.a AND c.b = y.b) SELECT round(sum({gap} * {gap} / e), 6)::DOUBLE AS statistic, (SELECT (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) FROM t) AS dof FROM f"""


@query(_chi("o_orderstatus", "o_orderpriority", "orders", False))
def ds14_chi_square(spark, d):
    return stats.chi_square(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select(F.round("statistic", 6).alias("statistic"), "dof")


@query(_chi("p_size > 25", "p_retailprice > 1400", "part", True))
def ds14_chi_square_yates(spark, d):
    p = load(spark, d, "part").select((F.col("p_size") > 25).alias("a"), (F.col("p_retailprice") > 1400).alias("b"))
    return stats.chi_square(p, "a", "b").select(F.round("statistic", 6).alias("statistic"), "dof")


@query("WITH m AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b, sum((n - 1) * v) AS w FROM m) SELECT round(b / (k - 1) / (w / (n - k)), 6)::DOUBLE AS f, CAST(k - 1 AS BIGINT) AS df_between, CAST(n - k AS BIGINT) AS df_within FROM t")
def ds15_anova(spark, d):
    return stats.anova(load(spark, d, "customer"), "c_mktsegment", "c_acctbal").select(F.round("f", 6).alias("f"), "df_between", "df_within")


@query("WITH m AS (SELECT l_returnflag AS g, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM m WHERE g = 'A'), b AS (SELECT * FROM m WHERE g = 'N') SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 3) AS dof FROM a, b")
def ds15_welch(spark, d):
    return stats.welch(load(spark, d, "lineitem"), "l_returnflag", "l_quantity", "A", "N").select(F.round("t", 6).alias("t"), F.round("dof", 3).alias("dof"))


@query("""WITH r AS (SELECT l_returnflag AS g, l_quantity AS v, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem), s AS (SELECT sum(q) AS q, sum(n)::DOUBLE AS n, count(*) - 1 AS dof FROM (SELECT sum(r) * sum(r) / count(*) AS q, count(*) AS n FROM r GROUP BY g)), t AS (SELECT sum(t ** 3 - t) AS t FROM (SELECT count(*)::DOUBLE AS t FROM r GROUP BY v))
 SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n)), 5) AS h, dof FROM s, t""")
def ds15_kruskal(spark, d):
    return stats.kruskal(load(spark, d, "lineitem"), "l_returnflag", "l_quantity").select(F.round("h", 5).alias("h"), "dof")


_KM = "(SELECT user_id, CAST(coalesce(min(CASE WHEN event_type = 'purchase' THEN event_id END), max(event_id)) // 500 AS BIGINT) AS t, CAST(bool_or(event_type = 'purchase') AS INTEGER) AS e FROM events GROUP BY 1)"


def _survival(spark, d):
    first = F.min(F.when(F.col("event_type") == "purchase", F.col("event_id")))
    g = load(spark, d, "events").groupBy("user_id").agg(F.floor(F.coalesce(first, F.max("event_id")) / 500).alias("t"), F.bool_or(F.col("event_type") == "purchase").cast("int").alias("e"))
    return g.withColumn("g", F.col("user_id") % 3)


@query()
def ds16_log_rank(spark, d):
    """Statistic, dof and p of the log-rank test over three groups; the sums are distributed, the small solve is not."""
    statistic, dof = stats.log_rank(_survival(spark, d), "t", "e", "g")
    return spark.createDataFrame([(round(statistic, 6), dof, round(stats.chi2_tail(statistic, max(dof, 1)), 6))], "statistic double, dof int, p double")


@query(f"WITH s AS (SELECT t, count(*) AS n, sum(e) AS d FROM {_KM} GROUP BY 1), r AS (SELECT t AS time, sum(n) OVER (ORDER BY t DESC) AS at_risk, d AS events FROM s) SELECT time, CAST(at_risk AS BIGINT) AS at_risk, CAST(events AS BIGINT) AS events, round(exp(sum(CASE WHEN events = at_risk THEN '-inf'::DOUBLE ELSE ln(1 - events / at_risk) END) OVER (ORDER BY time)), 6) AS survival FROM r WHERE events > 0")
def ds17_kaplan_meier(spark, d):
    return stats.kaplan_meier(_survival(spark, d), "t", "e").withColumn("survival", F.round("survival", 6))


@query("WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem WHERE l_returnflag IN ('A', 'N')) SELECT (sum(CASE WHEN g = 'A' THEN r END) - count(*) FILTER (WHERE g = 'A') * (count(*) FILTER (WHERE g = 'A') + 1) / 2.0)::DOUBLE AS u, count(*) FILTER (WHERE g = 'A') AS n1, count(*) FILTER (WHERE g = 'N') AS n2 FROM r")
def ds18_mann_whitney(spark, d):
    return stats.mann_whitney(load(spark, d, "lineitem"), "l_returnflag", "l_quantity", "A", "N")


@query()
def ds19_fisher(spark, d):
    """One-sided exact test of a 2 by 2 table; four counts reach the driver."""
    x, y = F.col("p_size") > 45, F.col("p_retailprice") > 1900
    a, b, c, e = load(spark, d, "part").agg(F.count_if(x & y), F.count_if(x & ~y), F.count_if(~x & y), F.count_if(~x & ~y)).first()
    return spark.createDataFrame([(a, b, c, e, round(stats.fisher_greater(a, b, c, e), 9))], "a long, b long, c long, d long, p double")


@query()
def ds20_pca(spark, d):
    return vectors.principal(load(spark, d, "embeddings"), "embedding", 2).select("vec_id", "label", F.round(F.abs(F.col("pca")[0]), 5).alias("pca1"), F.round(F.abs(F.col("pca")[1]), 5).alias("pca2"))


@query()
def ds21_kmeans(spark, d):
    """Clusters of the k with the best silhouette, by Euclidean distances between all rows."""
    out, scores = vectors.kmeans(load(spark, d, "embeddings"), "vec_id", "embedding", range(2, 9))
    sizes = out.groupBy("cluster").agg(F.count("*").alias("n"))
    best = max(scores, key=lambda s: s[1])
    whole = sizes.agg(F.sum("n").alias("total"), F.round(F.max("n") / F.greatest(F.min("n"), F.lit(1)), 2).alias("imbalance"))  # one row
    return sizes.crossJoin(F.broadcast(whole)).select("cluster", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), "imbalance", F.lit(best[0]).alias("k"), F.lit(round(best[1], 6)).alias("silhouette"))


@query()
def ds22_cluster_scores(spark, d):
    out = vectors.cluster_scores(load(spark, d, "embeddings"), "label", "embedding", 64)
    return out.select("k", F.round("calinski_harabasz", 6).alias("calinski_harabasz"), F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query()
def ds22_ward(spark, d):
    """Ward's tree over all embeddings."""
    return ward.tree(load(spark, d, "embeddings"), "vec_id", "embedding").select("a", "b", F.round("height", 6).alias("height"))


@query()
def ds22_ward_cuts(spark, d):
    """Scores of Ward's tree cut in 3, 4 and 5 clusters."""
    e = load(spark, d, "embeddings")
    merges, ks = ward.tree(e, "vec_id", "embedding"), (3, 4, 5)
    cuts, scores = e.select("vec_id", "embedding"), []
    for k in ks:
        cuts = cuts.join(ward.cut(e, "vec_id", merges, k).withColumnRenamed("cluster", f"k{k}"), "vec_id")
    cuts = kept(cuts)
    for k in ks:
        scores.append(vectors.cluster_scores(cuts, f"k{k}", "embedding", 64).withColumn("clustering", F.lit(f"k{k}")))
    both = reduce(lambda a, b: a.unionByName(b), scores).join(ward.silhouettes(cuts, "vec_id", "embedding", [f"k{k}" for k in ks]), "clustering")
    return both.select("k", *(F.round(c, 6).alias(c) for c in ("silhouette", "calinski_harabasz", "davies_bouldin")))


@query()
def ds23_feature_filter(spark, d):
    return wide.low_value_filter(load(spark, d, "embeddings"), "embedding", 1e-4, 0.95)


@query("SELECT p_partkey, " + ", ".join(f"CAST(p_type = '{t}' AS INTEGER) AS t{i}" for i, t in enumerate(("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))) + " FROM part")
def ds24_one_hot(spark, d):
    return load(spark, d, "part").select("p_partkey", *((F.col("p_type") == t).cast("int").alias(f"t{i}") for i, t in enumerate(("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))))


@query()
def ds25_char_svd(spark, d):
    """Latent vectors of names from the TF-IDF of their 2- to 4-grams of characters."""
    names = load(spark, d, "part").select(F.lower("p_name").alias("name")).distinct()
    out = models.char_latent(names, "name", 2000, 32)
    return out.select("name", F.size("latent").alias("dims"), F.round(vectors.norm(F.col("latent")), 4).alias("length"))


def _priced(spark, d):
    j = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("grp"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row"), F.col("l_extendedprice").cast("double").alias("y"), F.array(*(F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax"))).alias("x"))


def _errors(oof):
    return oof.groupBy("folds", "model").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg((F.col("y") - F.col("prediction")) * (F.col("y") - F.col("prediction")))), 2).alias("rmse"))


@query()
def ds26_out_of_fold(spark, d):
    """Out-of-fold errors of several models by folds of customers."""
    oof = models.out_of_fold(_priced(spark, d), "grp", "x", "y", 2, ("linear", "forest", "boosted", "network"))
    return _errors(oof.withColumn("folds", F.lit("group"))).drop("folds")


@query()
def ds26_plain_folds(spark, d):
    """The same of the linear model and the network by plain folds: rows are dealt out whatever their customer."""
    oof = models.out_of_fold(_priced(spark, d), "row", "x", "y", 2, ("linear", "network"))
    return _errors(oof.withColumn("folds", F.lit("plain")))


_MODELS = "(SELECT event_id AS k, 'a' AS model, value AS p FROM events UNION ALL SELECT event_id, 'b', value * 2 FROM events UNION ALL SELECT event_id, 'c', 100 - value FROM events UNION ALL SELECT event_id, 'd', 1 FROM events)"


@query(f"WITH w AS (SELECT 'a' AS model, 0.5 AS w UNION ALL SELECT 'b', 0.25 UNION ALL SELECT 'c', 0.25) SELECT k AS event_id, round(sum(p * w), 6)::DOUBLE AS ensemble FROM {_MODELS} JOIN w USING (model) GROUP BY 1")
def ds27_ensemble(spark, d):
    v = F.col("value")
    kinds = F.array(*(F.struct(F.lit(m).alias("model"), p.cast("double").alias("p")) for m, p in (("a", v), ("b", v * 2), ("c", 100 - v), ("d", F.lit(1.0)))))
    m = load(spark, d, "events").select("event_id", F.explode(kinds).alias("m")).select("event_id", "m.*")
    quality = spark.createDataFrame([("a", 0.8), ("b", 0.4), ("c", 0.4), ("d", -0.2)], "model string, quality double")
    return scoring.weighted_ensemble(m, "event_id", "model", "p", quality).select("event_id", F.round("ensemble", 6).alias("ensemble"))


@query("SELECT p_brand, arg_max(p_type, (round(g, 6), round(h, 6), -o)) AS winner FROM (SELECT p_brand, p_type, avg(p_size) AS g, avg(p_retailprice) AS h, min(p_partkey) AS o FROM part GROUP BY 1, 2) GROUP BY 1")
def ds28_winner(spark, d):
    """The best kind of each brand by two scores, the smaller id among equals."""
    t = load(spark, d, "part").groupBy("p_brand", "p_type").agg(F.avg("p_size").alias("g"), F.avg("p_retailprice").alias("h"), F.min("p_partkey").alias("o"))
    return t.groupBy("p_brand").agg(F.max_by("p_type", F.struct(F.round("g", 6), F.round("h", 6), -F.col("o"))).alias("winner"))


def _mean_over_regions(spark, d):
    s = load(spark, d, "part").crossJoin(F.broadcast(load(spark, d, "region")))  # five rows
    return s.groupBy("p_partkey").agg(F.round(F.avg(F.col("p_retailprice") / 100 + F.col("r_regionkey") * (F.col("p_size") % 5)), 4).alias("mean"))


@query("""WITH s AS (SELECT p_partkey, avg(p_retailprice / 100 + r_regionkey * (p_size % 5)) AS m FROM part, region GROUP BY 1) SELECT p_partkey, round(m, 4) AS mean, rank() OVER (ORDER BY round(m, 4)) AS rk FROM s""")
def ds29_rerank(spark, d):
    m = _mean_over_regions(spark, d)
    return m.join(stats.rank_table(m, "mean", "least"), "mean").select("p_partkey", "mean", F.col("rank_mean").cast("int").alias("rk"))


@query()
def ds30_embedding_scores(spark, d):
    """DistMult, TransE and ensemble scores of (brand, sold_in, nation) triples, scaled within each nation: the 25 best nations of each brand by either."""
    j = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sold = j.where("l_quantity > 48").select(F.col("p_brand").alias("head"), F.lit("sold_in").alias("relation"), F.col("s_nationkey").cast("string").alias("tail")).distinct()
    out = []
    for kind in ("distmult", "transe"):
        held, relations = triples.train(sold, kind)
        out.append(triples.best_tails(held, relations.get("sold_in", np.ones(16)), kind, 25).select("head", "tail", F.col("score").alias(kind)))
    return out[0].join(out[1], ["head", "tail"], "full").withColumn("score", F.round((F.coalesce("distmult", F.lit(0.0)) + F.coalesce("transe", F.lit(0.0))) / 2, 6))


@query("WITH v AS (SELECT DISTINCT p_name AS value FROM part) SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT) AS index FROM v")
def ds31_dictionary(spark, d):
    from ..operators.graph import dictionary

    return dictionary(load(spark, d, "part").select(F.col("p_name").alias("value")), "value")


@query("SELECT count(*) AS rows, CAST(max(len(embedding)) AS INTEGER) AS dims, CAST(sum(len(list_filter(embedding, lambda x: isnan(x)))) AS BIGINT) AS nans, CAST(sum(len(list_filter(embedding, lambda x: isinf(x)))) AS BIGINT) AS infinities, CAST(sum(len(list_filter(embedding, lambda x: x IS NULL))) AS BIGINT) AS nulls FROM embeddings")
def ds32_vector_quality(spark, d):
    return vectors.quality(load(spark, d, "embeddings"), "embedding")
