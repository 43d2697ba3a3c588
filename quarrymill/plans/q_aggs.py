"""Queries of aggregations (AG)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import min_max, row_mean, row_std
from ..operators import relational as R
from ..operators import scoring, stats, vectors
from ..sources.tables import load
from .registry import query


@query("SELECT p_brand, round(avg(p_retailprice), 4)::DOUBLE AS mean, round(stddev_samp(p_retailprice), 4)::DOUBLE AS std, count(*) AS n, round(avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS rate FROM part GROUP BY 1")
def ag01_named(spark, d):
    return load(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("mean"), F.round(F.stddev_samp("p_retailprice"), 4).alias("std"), F.count("*").alias("n"), F.round(F.avg((F.col("p_size") > 25).cast("double")), 4).alias("rate"))


@query("SELECT l_partkey, " + ", ".join(f"round({f}(l_{c}), 4)::DOUBLE AS {f}_{c}" for c in ("quantity", "discount") for f in ("min", "max", "avg")) + " FROM lineitem GROUP BY 1")
def ag02_dynamic(spark, d):
    aggs = [F.round(getattr(F, f)(f"l_{c}"), 4).alias(f"{f}_{c}") for c in ("quantity", "discount") for f in ("min", "max", "avg")]
    return load(spark, d, "lineitem").groupBy("l_partkey").agg(*aggs)


@query("SELECT c_mktsegment, round(median(c_acctbal), 4)::DOUBLE AS median, round(quantile_cont(c_acctbal, 0.9), 4)::DOUBLE AS q90 FROM customer GROUP BY 1")
def ag03_group_quantiles(spark, d):
    return load(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.median("c_acctbal"), 4).alias("median"), F.round(F.percentile("c_acctbal", F.lit(0.9)), 4).alias("q90"))


@query("SELECT " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 3)::DOUBLE AS q{i}" for i, q in enumerate((0.25, 0.3, 1 / 3, 2 / 3, 0.75))) + " FROM lineitem")
def ag04_quantiles(spark, d):
    q = stats.percentiles(load(spark, d, "lineitem"), "l_extendedprice", (0.25, 0.3, 1 / 3, 2 / 3, 0.75))
    return q.select(*(F.round(F.col("q")[i], 3).alias(f"q{i}") for i in range(5)))


@query("SELECT user_id, count(DISTINCT event_type) AS types FROM events GROUP BY 1")
def ag05_distinct(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("types"))


@query("SELECT n_nationkey, count(DISTINCT coalesce(c_mktsegment, 'none')) AS segments, count(DISTINCT lower(c_name)) AS names FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def ag06_distinct_coalesced(spark, d):
    j = load(spark, d, "nation").join(load(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_nationkey").agg(F.count_distinct(F.coalesce("c_mktsegment", F.lit("none"))).alias("segments"), F.count_distinct(F.lower("c_name")).alias("names"))


@query("SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount > 0.05) AS cheap, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS both FROM lineitem")
def ag07_filtered(spark, d):
    r = F.col("l_returnflag") == "R"
    return load(spark, d, "lineitem").agg(F.count_if(r).alias("returned"), F.count_if(F.col("l_discount") > 0.05).alias("cheap"), F.count_if(r & (F.col("l_linestatus") == "F")).alias("both"))


@query("SELECT p_name, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS brands, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 10")
def ag08_joined_distinct(spark, d):
    return load(spark, d, "part").groupBy("p_name").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ";").alias("brands"), F.count("*").alias("n")).where("n > 10")


@query("SELECT p_type, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS names FROM part GROUP BY 1")
def ag09_sorted_unique(spark, d):
    return load(spark, d, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_name")), "|").alias("names"))


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, '|' ORDER BY o) AS types FROM f GROUP BY 1")
def ag10_ordered_unique(spark, d):
    f = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("o"))
    return f.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "event_type"))), lambda x: x["event_type"]), "|").alias("types"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type || ':' || CAST(value > 50 AS VARCHAR)))), ',') AS kinds FROM events GROUP BY 1")
def ag11_collect_structs(spark, d):
    one = F.struct("event_type", (F.col("value") > 50).alias("high"))
    sets = load(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(one)).alias("s"))
    return sets.select("user_id", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["event_type"], x["high"].cast("string"))), ",").alias("kinds"))


@query("SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(CASE WHEN c_acctbal > 0 THEN c_mktsegment END) FILTER (WHERE c_acctbal > 0))), ',') AS segments FROM customer GROUP BY 1")
def ag12_array_without_nulls(spark, d):
    return load(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))), ",").alias("segments"))


@query("SELECT o_custkey, string_agg(o_orderkey || '=' || o_orderstatus, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def ag13_ordered_objects(spark, d):
    rows = load(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("s"))
    return rows.select("o_custkey", F.array_join(F.transform("s", lambda x: F.concat_ws("=", x["o_orderkey"], x["o_orderstatus"])), ",").alias("orders"))


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_linestatus = 'F') AS all_filled, CASE WHEN bool_or(l_returnflag = 'R') THEN 'returned' WHEN bool_or(l_linestatus = 'O') THEN 'open' ELSE 'done' END AS status FROM lineitem GROUP BY 1")
def ag14_status_rollup(spark, d):
    g = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.bool_and(F.col("l_linestatus") == "F").alias("all_filled"), F.bool_or(F.col("l_linestatus") == "O").alias("o"))
    return g.select("l_orderkey", "any_returned", "all_filled", F.when(F.col("any_returned"), "returned").when(F.col("o"), "open").otherwise("done").alias("status"))


@query("SELECT p_name, arg_min(p_brand, p_partkey) AS brand, arg_min(p_type, p_partkey) AS type FROM part GROUP BY 1")
def ag15_first(spark, d):
    return load(spark, d, "part").groupBy("p_name").agg(F.min_by("p_brand", "p_partkey").alias("brand"), F.min_by("p_type", "p_partkey").alias("type"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c) SELECT user_id, max(CASE WHEN rn = 1 THEN event_type END) AS top, string_agg(event_type || ':' || n, '|' ORDER BY n DESC, event_type) AS histogram FROM r GROUP BY 1")
def ag16_majority(spark, d):
    c = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    s = c.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type"))).alias("s"))
    return s.select("user_id", F.col("s")[0]["event_type"].alias("top"), F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["event_type"], -x["m"])), "|").alias("histogram"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def ag17_value_counts(spark, d):
    return load(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(v AS DOUBLE)), 5) AS mean FROM e GROUP BY 1, 2")
def ag18_vector_mean(spark, d):
    means = vectors.mean_vector(load(spark, d, "embeddings"), ["label"], "embedding", 64)
    return means.select("label", F.posexplode("embedding").alias("dim", "m")).select("label", "dim", F.round("m", 5).alias("mean"))


@query("WITH e AS (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT CAST(dim AS INTEGER) AS dim, round(var_samp(CAST(v AS DOUBLE)), 5) AS variance FROM e GROUP BY 1")
def ag19_variances(spark, d):
    return vectors.variances(load(spark, d, "embeddings"), "embedding").select("dim", F.round("variance", 5).alias("variance"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity + l_discount + l_tax) / 3, 6) AS mean, (l_discount > 0.05 OR l_tax > 0.05) AS any_high, CAST(l_discount > 0.05 AS INTEGER) + CAST(l_tax > 0.05 AS INTEGER) AS n_high FROM lineitem")
def ag20_across_columns(spark, d):
    q, a, b = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    high = [(a > 0.05), (b > 0.05)]
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(row_mean(q, a, b), 6).alias("mean"), (high[0] | high[1]).alias("any_high"), (high[0].cast("int") + high[1].cast("int")).alias("n_high"))


@query("SELECT l_orderkey, l_linenumber, round(0.5 * l_quantity + 0.3 * l_discount + 0.2 * l_tax, 6)::DOUBLE AS mean, round(sqrt(((l_quantity - m) * (l_quantity - m) + (l_discount - m) * (l_discount - m) + (l_tax - m) * (l_tax - m)) / 3), 6)::DOUBLE AS std FROM (SELECT *, (l_quantity + l_discount + l_tax) / 3 AS m FROM lineitem)")
def ag21_weighted_rows(spark, d):
    c = [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")]
    mean = F.lit(0.5) * c[0] + F.lit(0.3) * c[1] + F.lit(0.2) * c[2]
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(mean, 6).alias("mean"), F.round(row_std(*c), 6).alias("std"))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"arg_min(value, event_id) FILTER (WHERE event_type = '{t}') AS {t}" for t in _TYPES) + " FROM events GROUP BY 1")
def ag22_pivot_first(spark, d):
    return load(spark, d, "events").groupBy("user_id").pivot("event_type", list(_TYPES)).agg(F.min_by("value", "event_id"))


@query("SELECT user_id, " + ", ".join(f"CAST(bool_or(event_type = '{t}' AND value > 90) AS INTEGER) AS {t}" for t in _TYPES) + " FROM events GROUP BY 1")
def ag23_flag_matrix(spark, d):
    return load(spark, d, "events").groupBy("user_id").pivot("event_type", list(_TYPES)).agg(F.max((F.col("value") > 90).cast("int"))).na.fill(0)


@query("SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (WHERE substr(o_orderpriority, 1, 1) = '{i}') AS p{i}" for i in range(1, 6)) + " FROM orders GROUP BY 1")
def ag24_crosstab(spark, d):
    p = F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1))
    return load(spark, d, "orders").withColumn("p", p).groupBy("o_orderstatus").pivot("p", [f"p{i}" for i in range(1, 6)]).count().na.fill(0)


@query("SELECT o_orderstatus, o_orderpriority, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 4)::DOUBLE AS pct FROM orders GROUP BY 1, 2")
def ag25_crosstab_pct(spark, d):
    g = load(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return g.select("o_orderstatus", "o_orderpriority", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus")), 4).alias("pct"))


@query("SELECT l_shipmode, n, n_flag, rate FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS n_flag, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rate FROM lineitem GROUP BY 1)")
def ag26_flag_rates(spark, d):
    f = F.col("l_discount") > 0.05
    return load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.count("*").alias("n"), F.count_if(f).alias("n_flag"), F.round(F.avg(f.cast("double")), 6).alias("rate"))


@query("SELECT 'part' AS name, count(*) AS rows FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents")
def ag27_source_counts(spark, d):
    from ..operators.validate import counts

    return counts({n: load(spark, d, n) for n in ("part", "orders", "documents")})


@query("SELECT round((c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w), 6) AS scaled, c_custkey FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def ag29_group_min_max(spark, d):
    return load(spark, d, "customer").select("c_custkey", F.round(min_max(F.col("c_acctbal"), F.col("c_nationkey")), 6).alias("scaled"))


@query("WITH r AS (SELECT *, rank() OVER (ORDER BY p_retailprice DESC) AS rk FROM part) SELECT 50 AS k, count(*) FILTER (WHERE p_size > 25) AS hits, round(avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS precision FROM r WHERE rk <= 50")
def ag30_precision(spark, d):
    p = load(spark, d, "part")
    least = p.select("p_retailprice").orderBy(F.desc("p_retailprice")).limit(50).agg(F.min("p_retailprice").alias("least"))  # ranks up to 50 have this price or more, ties too
    r = p.crossJoin(F.broadcast(least)).where("p_retailprice >= least").withColumn("rk", F.lit(1))
    return scoring.precision_at(r, "rk", F.col("p_size") > 25, 50).withColumn("precision", F.round("precision", 6))


@query("WITH m AS (SELECT median(l_quantity) AS m FROM lineitem), g AS (SELECT l_partkey, avg(l_quantity) AS a FROM lineitem GROUP BY 1) SELECT count(*) FILTER (WHERE a > m) AS hits, count(*) AS n FROM g, m")
def ag31_above_median(spark, d):
    li = load(spark, d, "lineitem")
    g = li.groupBy("l_partkey").agg(F.avg("l_quantity").alias("a"))
    return g.crossJoin(F.broadcast(li.agg(F.median("l_quantity").alias("m")))).agg(F.count_if(F.col("a") > F.col("m")).alias("hits"), F.count("*").alias("n"))


@query("SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def ag32_duplicates(spark, d):
    from ..operators.validate import duplicates

    return duplicates(load(spark, d, "part"), ["p_name", "p_brand"])


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS statuses, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1")
def ag_er06_accumulate(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("priority"))
    out = R.merge_lists(o, "o_custkey", "o_orderkey", ["o_orderstatus"], ["priority"])
    return out.select("o_custkey", F.array_join(F.array_sort(F.split("o_orderstatus", r"\|")), "|").alias("statuses"), "priority")
