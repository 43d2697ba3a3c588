"""Queries of windows, ranks, sorts and limits (WN, SR), with the flagship ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import average_rank
from ..operators import relational as R
from ..operators import scoring, stats
from ..sources.tables import load
from .registry import query

_FINAL = """WITH agg AS (SELECT s_nationkey AS g, l_partkey AS item_id, round(sum(l_extendedprice), 2) AS score FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
 ranked AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY score DESC) AS item_rank FROM agg),
 named AS (SELECT r.*, p_name, row_number() OVER (PARTITION BY g, lower(p_name) ORDER BY item_rank NULLS LAST, item_id) AS rn FROM ranked r LEFT JOIN part ON p_partkey = item_id)
 SELECT n_name AS grp, item_id, p_name, item_rank, score FROM named JOIN nation ON n_nationkey = g WHERE rn = 1"""


@query(_FINAL)
def final_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Best entry of each name in each group: aggregate, rank, one row for each name."""
    li = load(spark, d, "lineitem").join(load(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    agg = li.groupBy(F.col("s_nationkey").alias("g"), F.col("l_partkey").alias("item_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("score"))
    ranked = agg.withColumn("item_rank", F.rank().over(Window.partitionBy("g").orderBy(F.desc("score"))))
    named = ranked.join(load(spark, d, "part"), F.col("p_partkey") == F.col("item_id"), "left").withColumn("_l", F.lower("p_name"))
    one = R.first_by(named, ["g", "_l"], F.asc_nulls_last("item_rank"), F.asc("item_id"))
    return one.join(load(spark, d, "nation"), F.col("n_nationkey") == F.col("g")).select(F.col("n_name").alias("grp"), "item_id", "p_name", "item_rank", "score")


def _percentile(v: str) -> str:
    return f"CASE WHEN min({v}) OVER () = max({v}) OVER () THEN 0.5 ELSE (rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 - 1) / (count(*) OVER () - 1) END"


@query(f"""WITH r AS (SELECT o_custkey, l_partkey, l_extendedprice AS y, rank() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice) AS rk FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 a AS (SELECT l_partkey, -avg(y) AS m, avg(CASE WHEN rk <= 5 THEN 1.0 ELSE 0.0 END) AS t5, avg(CASE WHEN rk <= 10 THEN 1.0 ELSE 0.0 END) AS t10, avg(CASE WHEN rk <= 20 THEN 1.0 ELSE 0.0 END) AS t20 FROM r GROUP BY 1)
 SELECT l_partkey, round(0.4 * ({_percentile("m")}) + 0.3 * ({_percentile("t20")}) + 0.2 * ({_percentile("t10")}) + 0.1 * ({_percentile("t5")}), 6)::DOUBLE AS composite FROM a""")
def composite_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Blend of percentile scores of the mean prediction and the top-k rates of every part (DS01)."""
    pairs = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey", "l_extendedprice")
    rates = scoring.top_k_rates(pairs, "o_custkey", "l_partkey", "l_extendedprice")
    out = scoring.composite(rates, {"-mean_pred": 0.4, "top20_rate": 0.3, "top10_rate": 0.2, "top5_rate": 0.1})
    return out.select("l_partkey", F.round("composite", 6).alias("composite"))


@query("SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal, -2)) AS rk FROM customer")
def wn02_rank_min(spark, d):
    return load(spark, d, "customer").select("c_custkey", F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.round("c_acctbal", -2))).alias("rk"))


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS rk FROM part")
def wn03_rank_average(spark, d):
    return load(spark, d, "part").select("p_partkey", average_rank(F.col("p_size"), F.col("p_brand")).alias("rk"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rk FROM part")
def wn04_rank_first(spark, d):
    return load(spark, d, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")).alias("rk"))


@query("SELECT p_partkey, dense_rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) AS rk FROM part")
def wn05_dense_rank(spark, d):
    return load(spark, d, "part").select("p_partkey", F.dense_rank().over(Window.partitionBy("p_type").orderBy(F.desc("p_size"))).alias("rk"))


@query(f"WITH a AS (SELECT l_partkey, round(avg(l_quantity), 2) AS m FROM lineitem GROUP BY 1) SELECT l_partkey, round({_percentile('m')}, 6)::DOUBLE AS score FROM a")
def wn06_percentile_score(spark, d):
    a = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 2).alias("m"))
    return stats.percentile_scores(a, {"score": F.col("m")}).select("l_partkey", F.round("score", 6).alias("score"))


@query("WITH v AS (SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) / count(*) OVER (PARTITION BY c_mktsegment) <= 0.1 THEN 1 ELSE 0 END AS a, CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) / count(*) OVER (PARTITION BY c_nationkey) <= 0.1 THEN 1 ELSE 0 END AS b FROM customer) SELECT c_custkey, a + b AS votes FROM v")
def wn07_votes(spark, d):
    def vote(by):
        w = Window.partitionBy(by)
        return (F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey")) / F.count("*").over(w) <= 0.1).cast("int")

    return load(spark, d, "customer").select("c_custkey", (vote("c_mktsegment") + vote("c_nationkey")).alias("votes"))


@query("WITH q AS (SELECT quantile_cont(p_retailprice, 1/3.0) AS a, quantile_cont(p_retailprice, 2/3.0) AS b FROM part) SELECT p_partkey, CASE WHEN p_retailprice >= b THEN 'A' WHEN p_retailprice >= a THEN 'B' ELSE 'C' END AS grade FROM part, q")
def wn08_terciles(spark, d):
    return scoring.tercile_grade(load(spark, d, "part"), "p_retailprice").select("p_partkey", "grade")


@query("SELECT p_partkey, CAST(rk <= 5 AS INTEGER) AS top5, CAST(rk <= 10 AS INTEGER) AS top10, CAST(rk <= 20 AS INTEGER) AS top20 FROM (SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS rk FROM part)")
def wn09_top_flags(spark, d):
    rk = F.rank().over(Window.partitionBy("p_brand").orderBy("p_retailprice"))
    return load(spark, d, "part").withColumn("rk", rk).select("p_partkey", *((F.col("rk") <= k).cast("int").alias(f"top{k}") for k in (5, 10, 20)))


@query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name), p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def wn10_keep_first(spark, d):
    p = load(spark, d, "part").withColumn("_l", F.lower("p_name"))
    return R.first_by(p, ["_l", "p_type"], F.desc("p_retailprice"), F.asc("p_partkey")).select("p_partkey", "p_name")


@query("""WITH o AS (SELECT *, p_size > 5 AS ok, coalesce(bool_or(p_size > 5) OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pos FROM part),
 k AS (SELECT *, sum(CASE WHEN ok AND NOT seen THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS picked FROM o), e AS (SELECT min(pos) AS last FROM k WHERE picked = 30)
 SELECT p_partkey, CASE WHEN pos > coalesce(last, pos) THEN 'not_reached' WHEN seen THEN 'skip_duplicate' WHEN NOT ok THEN 'skip_missing' ELSE 'select' END AS action FROM k, e""")
def wn11_greedy_select(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return R.greedy_select(p, [("p_retailprice", True), ("p_partkey", False)], "p_name", 30, F.col("p_size") > 5).select("p_partkey", "action")


@query("SELECT p_partkey, round((p_size - min(p_size) OVER w) / nullif(max(p_size) OVER w - min(p_size) OVER w, 0)::DOUBLE + 1.0 / rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice), 6)::DOUBLE AS bonus FROM part WINDOW w AS (PARTITION BY p_brand)")
def wn12_bonus(spark, d):
    w = Window.partitionBy("p_brand")
    span = (F.col("p_size") - F.min("p_size").over(w)) / (F.max("p_size").over(w) - F.min("p_size").over(w))
    return load(spark, d, "part").select("p_partkey", F.round(span + 1.0 / F.rank().over(w.orderBy("p_retailprice")), 6).alias("bonus"))


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS number FROM supplier")
def wn13_renumber(spark, d):
    from ..operators.graph import dictionary

    key = F.struct((-F.col("s_acctbal")).alias("a"), "s_suppkey")
    numbered = dictionary(load(spark, d, "supplier").select(key.alias("k")), "k")
    return numbered.select(F.col("k.s_suppkey").alias("s_suppkey"), (F.col("index") + 1).alias("number"))


@query("SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS best FROM customer GROUP BY 1")
def wn14_best_of(spark, d):
    return load(spark, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("best"))


@query("SELECT p_partkey, p_brand, p_size, row_number() OVER (ORDER BY p_brand, p_size DESC, p_retailprice, p_partkey) AS pos FROM part QUALIFY pos <= 100")
def sr01_mixed_sort(spark, d):
    order = [F.asc("p_brand"), F.desc_nulls_last("p_size"), F.asc_nulls_last("p_retailprice"), F.asc("p_partkey")]
    top = load(spark, d, "part").orderBy(*order).limit(100)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order))).select("p_partkey", "p_brand", "p_size", "pos")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders) ORDER BY p ASC NULLS LAST, o_orderkey LIMIT 50")
def sr02_nulls_last(spark, d):
    p = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice"))
    return load(spark, d, "orders").orderBy(p.asc_nulls_last(), "o_orderkey").limit(50).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def sr04_page(spark, d):
    return load(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def sr05_head(spark, d):
    return load(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_retailprice")


@query("SELECT p_name, p_partkey FROM (SELECT *, dense_rank() OVER (ORDER BY p_name) AS r FROM part) WHERE r <= 5")
def sr06_limit_entities(spark, d):
    p = load(spark, d, "part")
    names = p.select("p_name").distinct().orderBy("p_name").limit(5)
    return p.join(F.broadcast(names), "p_name", "left_semi").select("p_name", "p_partkey")  # five names


@query("WITH e AS (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT CAST(dim AS INTEGER) AS dim FROM e GROUP BY dim ORDER BY var_samp(CAST(v AS DOUBLE)) DESC, dim LIMIT 8")
def sr07_top_variance(spark, d):
    from ..operators.vectors import variances

    return variances(load(spark, d, "embeddings"), "embedding").limit(8).select("dim")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) AS pos FROM orders QUALIFY pos <= 60")
def sr03_stable_sort(spark, d):
    """Ties keep the order of the key, so repeated runs agree."""
    top = load(spark, d, "orders").orderBy("o_orderstatus", "o_orderkey").limit(60)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy("o_orderstatus", "o_orderkey")).alias("pos"))
