"""Queries of projections and filters (PRJ, FLT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators import stats
from ..sources.tables import load
from .registry import query


@query("SELECT p_partkey AS id, p_name AS name, '' AS notes FROM part")
def prj01_shape(spark, d):
    return R.shaped(load(spark, d, "part"), {"p_partkey": "id", "p_name": "name"}, ["id", "name", "notes"])


@query("SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END), ''), c_name, '') AS label FROM customer")
def prj02_first_value(spark, d):
    c = load(spark, d, "customer").withColumn("label_a", F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")))
    return c.select("c_custkey", R.coalesce_text("LABEL_A", "missing", "C_NAME")(c).alias("label"))


@query("SELECT p_brand AS target, count(*) AS n FROM part GROUP BY 1")
def prj04_best_column(spark, d):
    p = load(spark, d, "part").withColumn("empty", F.lit("nan"))
    best = R.best_filled_column(p, ["absent", "empty", "p_brand", "p_type"])
    return p.groupBy(F.col(best).alias("target")).agg(F.count("*").alias("n"))


@query("SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem")
def prj06_numeric_columns(spark, d):
    df = load(spark, d, "lineitem")
    names = R.numeric_columns(df, ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return df.agg(*(F.round(F.avg(c), 4 if c == "l_extendedprice" else 6).alias(c) for c in names))


@query("SELECT kind, count(*) AS n FROM (SELECT unnest(['l_orderkey','l_partkey','l_suppkey','l_quantity','l_extendedprice','l_discount','l_tax']) AS c) t, LATERAL (SELECT CASE WHEN c LIKE '%key' THEN 'key' ELSE 'feature' END AS kind) GROUP BY 1")
def prj07_column_kinds(spark, d):
    names = [(c, "key" if c.endswith("key") else "feature") for c in R.numeric_columns(load(spark, d, "lineitem"), ("l_linenumber",))]
    return spark.createDataFrame(names, "c string, kind string").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS x_s_suppkey, s_acctbal AS x_s_acctbal FROM supplier")
def prj08_prefix(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return s.toDF(*(f"x_{c}" for c in s.columns))


@query("SELECT n_nationkey, n_name FROM nation")
def prj09_distinct_columns(spark, d):
    n = load(spark, d, "nation")
    doubled = n.select("n_nationkey", "n_name", F.col("n_nationkey").alias("N_NATIONKEY_2"))
    keep = {c.lower().removesuffix("_2"): c for c in reversed(doubled.columns)}
    return doubled.select(*(c for c in doubled.columns if c in keep.values()))


@query("SELECT o_orderkey, CASE WHEN trim(o_orderstatus) = 'P' THEN o_orderpriority ELSE o_orderstatus END AS status FROM orders")
def prj10_fill_from_other(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.when(F.trim("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("status"))


@query("SELECT c_custkey, coalesce(max(o_totalprice), 0.0) AS most, coalesce(max(o_orderstatus), '') AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def prj11_fill_by_type(spark, d):
    j = load(spark, d, "customer").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.max("o_totalprice").alias("most"), F.max("o_orderstatus").alias("status")).na.fill(0.0).na.fill("")


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS x FROM events")
def prj12_coerce(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("user_id").cast("string"))
    return load(spark, d, "events").select("event_id", raw.try_cast("double").alias("x"))


@query("WITH q AS (SELECT quantile_cont(l_extendedprice, 0.3) AS q FROM lineitem) SELECT CAST(l_extendedprice <= q AS INTEGER) AS low, count(*) AS n FROM lineitem, q GROUP BY 1")
def prj13_threshold_flag(spark, d):
    li = load(spark, d, "lineitem").select("l_extendedprice")
    q = stats.percentiles(li, "l_extendedprice", (0.3,)).select(F.col("q")[0].alias("q"))
    return li.crossJoin(F.broadcast(q)).groupBy((F.col("l_extendedprice") <= F.col("q")).cast("int").alias("low")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'available' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'missing' ELSE 'failed' END AS state FROM orders")
def prj14_status_map(spark, d):
    return load(spark, d, "orders").select("o_orderkey", X.lookup(F.col("o_orderstatus"), {"F": "available", "O": "pending", "P": "missing"}, "failed").alias("state"))


_FLAGS = "SELECT p_partkey, p_size > 45 AS big, p_retailprice > 1900 AS dear, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 3 END AS alerts FROM part"


def _flags(spark, d):
    alerts = F.when(F.col("p_partkey") % 11 != 0, F.col("p_partkey") % 3)
    return load(spark, d, "part").select("p_partkey", (F.col("p_size") > 45).alias("big"), (F.col("p_retailprice") > 1900).alias("dear"), alerts.alias("alerts"))


@query(f"SELECT p_partkey, (big OR dear OR coalesce(alerts, 99) > 0) AS hard_fail FROM ({_FLAGS})")
def prj15_hard_fail(spark, d):
    return _flags(spark, d).select("p_partkey", (F.col("big") | F.col("dear") | (F.coalesce("alerts", F.lit(99)) > 0)).alias("hard_fail"))


@query(f"SELECT p_partkey, CASE WHEN big AND dear THEN 'FAIL' WHEN big OR dear OR alerts > 1 THEN 'WARNING' ELSE 'PASS' END AS status FROM ({_FLAGS})")
def prj16_three_states(spark, d):
    rules = [(F.col("big") & F.col("dear"), "FAIL"), (F.col("big") | F.col("dear") | (F.col("alerts") > 1), "WARNING")]
    return _flags(spark, d).select("p_partkey", R.when_chain(rules, "PASS").alias("status"))


@query(f"SELECT p_partkey, concat_ws(';', CASE WHEN big THEN 'big' END, CASE WHEN dear THEN 'dear' END, CASE WHEN alerts > 1 THEN 'alerts' END) AS reasons FROM ({_FLAGS})")
def prj17_reasons(spark, d):
    return _flags(spark, d).select("p_partkey", X.joined_reasons([(F.col("big"), "big"), (F.col("dear"), "dear"), (F.col("alerts") > 1, "alerts")]).alias("reasons"))


@query("SELECT p_partkey, CASE WHEN p_size <= 10 AND p_retailprice < 1200 THEN 'tier1' WHEN p_size <= 25 THEN 'tier2' WHEN p_type = 'PROMO' THEN 'tier3' ELSE 'tier4' END AS tier FROM part")
def prj18_tiers(spark, d):
    rules = [((F.col("p_size") <= 10) & (F.col("p_retailprice") < 1200), "tier1"), (F.col("p_size") <= 25, "tier2"), (F.col("p_type") == "PROMO", "tier3")]
    return load(spark, d, "part").select("p_partkey", R.when_chain(rules, "tier4").alias("tier"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 2 ELSE 1 END AS points FROM customer")
def prj19_points(spark, d):
    return load(spark, d, "customer").select("c_custkey", X.lookup(F.col("c_mktsegment"), {"BUILDING": 3, "MACHINERY": 2}, 1).alias("points"))


@query("SELECT p_partkey, (CASE WHEN p_size < 10 THEN 3 ELSE 0 END) + (CASE WHEN p_retailprice < 1500 THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(p_name), 'a') THEN 1 ELSE 0 END) + (CASE WHEN p_type = 'PROMO' THEN 2 ELSE 0 END) AS points FROM part")
def prj20_keyword_points(spark, d):
    rules = [(F.col("p_size") < 10, 3), (F.col("p_retailprice") < 1500, 1), (F.lower("p_name").contains("a"), 1), (F.col("p_type") == "PROMO", 2)]
    return load(spark, d, "part").select("p_partkey", sum((F.when(c, n).otherwise(0) for c, n in rules), F.lit(0)).alias("points"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'last' WHEN p_size > 20 THEN 'second' WHEN p_size > 10 THEN 'first' ELSE 'none' END AS state FROM part")
def prj21_overwrites(spark, d):
    rules = [(F.col("p_size") > 10, "first"), (F.col("p_size") > 20, "second"), (F.col("p_partkey") % 5 == 0, "last")]
    return load(spark, d, "part").select("p_partkey", R.when_chain(rules, "none", last_wins=True).alias("state"))


@query(f"SELECT p_partkey, CASE WHEN dear THEN 'EXCLUDE' WHEN big THEN 'CAUTION' ELSE 'KEEP' END AS decision, CASE WHEN dear THEN 'price' WHEN big THEN 'size' ELSE '' END AS reason FROM ({_FLAGS})")
def prj22_decisions(spark, d):
    pair = lambda a, b: F.struct(F.lit(a).alias("decision"), F.lit(b).alias("reason"))
    both = R.when_chain([(F.col("dear"), pair("EXCLUDE", "price")), (F.col("big"), pair("CAUTION", "size"))], pair("KEEP", ""))
    return _flags(spark, d).select("p_partkey", both.alias("x")).select("p_partkey", "x.*")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, source) AS tag FROM documents")
def prj23_combine_first(spark, d):
    return load(spark, d, "documents").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("source")).alias("tag"))


@query("SELECT c_custkey FROM customer WHERE upper(trim(c_mktsegment)) = 'BUILDING'")
def flt01_equal_folded(spark, d):
    return load(spark, d, "customer").where(F.upper(F.trim("c_mktsegment")) == "BUILDING").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def flt02_membership(spark, d):
    return load(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'licen[cs]e')")
def flt03_contains(spark, d):
    return load(spark, d, "documents").where(F.lower("text").rlike("licen[cs]e")).select("doc_id")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%re%' OR p_brand ILIKE '%1%' OR p_type ILIKE '%promo%'")
def flt04_ilike_any(spark, d):
    return load(spark, d, "part").where(F.col("p_name").ilike("%re%") | F.col("p_brand").ilike("%1%") | F.col("p_type").ilike("%promo%")).select("p_partkey")


@query("SELECT n_nationkey FROM nation WHERE lower(n_name) = lower('NATION_3')")
def flt05_equal_any_case(spark, d):
    return load(spark, d, "nation").where(F.lower("n_name") == F.lower(F.lit("NATION_3"))).select("n_nationkey")


def orders_filtered(spark, d, status=None, least=None, priority=None):
    """Only the filters that are given; all of them reach the scan."""
    df = load(spark, d, "orders")
    for c in [F.col("o_orderstatus") == status] * (status is not None) + [F.col("o_totalprice") >= least] * (least is not None) + [F.col("o_orderpriority") == priority] * (priority is not None):
        df = df.where(c)
    return df


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def flt06_dynamic(spark, d):
    return orders_filtered(spark, d, status="F", least=100000).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE coalesce(l_returnflag, '') <> 'N' OR coalesce(l_linestatus, '') NOT IN ('O', 'F')")
def flt07_not_passed(spark, d):
    return load(spark, d, "lineitem").where((F.coalesce("l_returnflag", F.lit("")) != "N") | ~F.coalesce("l_linestatus", F.lit("")).isin("O", "F")).select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE value >= 70 AND event_type <> 'view'")
def flt08_threshold(spark, d):
    return load(spark, d, "events").where("value >= 70 AND event_type <> 'view'").select("event_id")


@query("SELECT count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id END AS a, lang AS b FROM documents) WHERE a IS NOT NULL AND b IS NOT NULL")
def flt09_drop_missing(spark, d):
    df = load(spark, d, "documents").select(F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")).alias("a"), F.col("lang").alias("b"))
    return df.na.drop(subset=["a", "b"]).agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part)) AS only_left, (SELECT count(*) FROM (SELECT DISTINCT l_partkey FROM lineitem INTERSECT SELECT p_partkey FROM part)) AS both, (SELECT count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem)) AS only_right")
def flt10_set_equality(spark, d):
    return R.set_sizes(load(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), load(spark, d, "part").select(F.col("p_partkey").alias("k")), "k")


@query("SELECT c_custkey FROM customer WHERE substr(string_split(c_name, '#')[2], 9, 1) IN ('1', '6') OR string_split(c_name, '_')[2] IN ('1', '6')")
def flt11_code_part(spark, d):
    at = lambda sep, i: F.get(F.split("c_name", sep), F.lit(i))
    return load(spark, d, "customer").where(F.coalesce(F.substring(at("#", 1), 9, 1).isin("1", "6"), F.lit(False)) | F.coalesce(at("_", 1).isin("1", "6"), F.lit(False))).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderstatus, 'URGENT|P') OR regexp_matches(o_orderpriority, 'URGENT|P')")
def flt12_all_text_columns(spark, d):
    df = load(spark, d, "orders")
    return df.where(R.search_columns(df, "URGENT|P")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]1$')")
def flt13_not_matching(spark, d):
    return load(spark, d, "part").where(~F.col("p_brand").rlike("^Brand#[0-9]1$")).select("p_partkey")


@query("SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1")
def prj03_first_existing(spark, d):
    c = load(spark, d, "customer")
    return c.groupBy(F.col(R.first_existing_column(c, ["segment", "C_MktSegment"])).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT o_orderkey) AS keys FROM orders")
def prj05_key_column(spark, d):
    o = load(spark, d, "orders")
    return o.agg(F.count_distinct(R.key_column(o, ["patient_id", "o_orderkey"], "key")).alias("keys"))
