"""Queries of entity resolution and graphs (ER, GR)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import relational as R
from ..operators.validate import counts
from ..sources.tables import load
from .registry import query


def _parts(spark, d):
    return load(spark, d, "part").withColumn("k2", F.when(F.col("p_size") < 8, F.concat_ws("/", "p_brand", "p_size")))


def _linked(p):
    return G.components(p, "p_partkey", G.links_by_keys(p, "p_partkey", ["p_retailprice", "k2"]))


@query()
def er01_components(spark, d):
    """Entities linked by either of two keys; recursive SQL is too slow for the whole table, a union-find stands in for it in the tests."""
    return _linked(_parts(spark, d))


@query()
def er02_representative(spark, d):
    """The representative of every component."""
    return _representative(er01_components(spark, d), load(spark, d, "part"))


def _representative(found, p):
    c = found.join(p, "p_partkey")
    order = F.struct(F.when(F.col("p_size") > 20, 0).otherwise(1), F.length("p_name"), "p_name", "p_partkey")
    return c.groupBy("component").agg(F.min_by("p_name", order).alias("name"), F.count("*").alias("n"))


_ALIAS = "WITH a AS (SELECT lower(p_name) AS alias, min(p_partkey) AS id FROM part WHERE p_size > 10 GROUP BY 1), e AS (SELECT DISTINCT lower(p_name) AS alias FROM part WHERE p_size <= 10)"


@query(f"{_ALIAS} SELECT coalesce(a.alias, e.alias) AS alias, id, CASE WHEN a.alias IS NULL THEN 'evidence_only' ELSE 'matched' END AS match_status FROM a FULL JOIN e ON a.alias = e.alias")
def er03_alias_table(spark, d):
    p = load(spark, d, "part").withColumn("alias", F.lower("p_name"))
    a = p.where("p_size > 10").groupBy("alias").agg(F.min("p_partkey").alias("id"))
    rest = p.where("p_size <= 10").select("alias").distinct().join(a, "alias", "left_anti")
    return a.withColumn("match_status", F.lit("matched")).unionByName(rest.select("alias", F.lit(None).cast("long").alias("id"), F.lit("evidence_only").alias("match_status")))


@query("WITH p AS (SELECT p_partkey AS k, p_name AS n FROM part WHERE p_partkey % 2 = 0), f AS (SELECT p_partkey AS k, p_name AS n FROM part WHERE p_size > 45) SELECT k, n, k IN (SELECT k FROM f) AS is_final FROM p UNION ALL SELECT k, n, true FROM f WHERE k NOT IN (SELECT k FROM p)")
def er04_pool_merge(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"), "p_size")
    f = p.where("p_size > 45").select("k", "n").withColumn("is_final", F.lit(True))
    pool = p.where("k % 2 = 0").select("k", "n")
    flagged = pool.join(f.select("k", "is_final"), "k", "left").na.fill(False, ["is_final"])
    return flagged.unionByName(f.join(pool, "k", "left_anti"))


@query("SELECT o_custkey, arg_min(CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END, CASE WHEN o_orderstatus <> 'O' THEN o_orderkey END) AS priority, count(*) AS observations FROM orders GROUP BY 1")
def er05_first_filled(spark, d):
    o = load(spark, d, "orders")
    held = F.col("o_orderstatus") != "O"
    return o.groupBy("o_custkey").agg(F.min_by(F.when(held, F.col("o_orderpriority")), F.when(held, F.col("o_orderkey"))).alias("priority"), F.count("*").alias("observations"))


@query("WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), b AS (SELECT DISTINCT lower(p_brand) AS b, lower(replace(p_brand, '#', '')) AS c FROM part) SELECT p_partkey, w AS term, CASE WHEN length(w) > 5 THEN 'exact' ELSE 'alias' END AS status, CASE WHEN length(w) > 5 THEN 0.95 ELSE 0.80 END::DOUBLE AS confidence FROM w")
def er07_link_rows(spark, d):
    w = load(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("term"))
    exact = F.length("term") > 5
    return w.select("p_partkey", "term", F.when(exact, "exact").otherwise("alias").alias("status"), F.when(exact, F.lit(0.95)).otherwise(F.lit(0.80)).alias("confidence"))


_HITS = "SELECT q, count(p_partkey) AS hits, min(p_partkey) AS best FROM (SELECT DISTINCT p_size AS q FROM part) LEFT JOIN part ON p_size = q AND p_retailprice > 1900 GROUP BY 1"


@query(f"SELECT q, hits, CASE WHEN hits = 1 THEN 'auto_suggested' WHEN hits > 1 THEN 'needs_review_multi_hit' WHEN q % 13 = 0 THEN 'query_failed' ELSE 'unresolved' END AS status FROM ({_HITS})")
def er08_hit_status(spark, d):
    p = load(spark, d, "part")
    hits = p.select(F.col("p_size").alias("q")).distinct().join(p.where("p_retailprice > 1900"), F.col("p_size") == F.col("q"), "left").groupBy("q").agg(F.count("p_partkey").alias("hits"))
    n = F.col("hits")
    return hits.withColumn("status", R.when_chain([(n == 1, "auto_suggested"), (n > 1, "needs_review_multi_hit"), (F.col("q") % 13 == 0, "query_failed")], "unresolved"))


@query(f"SELECT CASE WHEN hits = 1 THEN 'accepted' ELSE 'hold' END AS part, count(*) AS n FROM ({_HITS}) GROUP BY 1")
def er09_accept_or_hold(spark, d):
    s = er08_hit_status(spark, d)
    parts = [s.where(F.col("status") == "auto_suggested").agg(F.lit("accepted").alias("part"), F.count("*").alias("n")), s.where(F.col("status") != "auto_suggested").agg(F.lit("hold").alias("part"), F.count("*").alias("n"))]
    return reduce(DataFrame.unionByName, parts).where("n > 0")


_MENTIONS = "(SELECT n_name AS m, 'nation' AS src, n_nationkey AS k FROM nation UNION ALL SELECT 'NATION_' || s_nationkey, 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'NATION_' || c_nationkey, 'customer', c_custkey FROM customer)"


@query(f"WITH c AS (SELECT m, src, count(*) AS n FROM {_MENTIONS} GROUP BY 1, 2), t AS (SELECT m, src || '-' || k AS f, row_number() OVER (PARTITION BY m ORDER BY src || '-' || k) AS r FROM {_MENTIONS}) SELECT m AS mention, CAST(sum(n) AS BIGINT) AS n, string_agg(src || ':' || n, ';' ORDER BY src) AS breakdown, (SELECT string_agg(f, ',' ORDER BY f) FROM t WHERE t.m = c.m AND r <= 5) AS firsts FROM c GROUP BY 1")
def er10_mentions(spark, d):
    one = lambda t, name, key, src: load(spark, d, t).select(name.alias("mention"), F.lit(src).alias("src"), F.concat_ws("-", F.lit(src), key).alias("f"))
    prefixed = lambda c: F.concat(F.lit("NATION_"), c)
    rows = reduce(DataFrame.unionByName, [one("nation", F.col("n_name"), "n_nationkey", "nation"), one("supplier", prefixed("s_nationkey"), "s_suppkey", "supplier"), one("customer", prefixed("c_nationkey"), "c_custkey", "customer")])
    c = rows.groupBy("mention", "src").agg(F.count("*").alias("n")).groupBy("mention").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("src", "n"))), lambda x: F.concat_ws(":", x["src"], x["n"])), ";").alias("breakdown"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("mention").orderBy("f"))).where("r <= 5").groupBy("mention").agg(F.array_join(F.sort_array(F.collect_list("f")), ",").alias("firsts"))
    return c.join(first, "mention")


@query("SELECT p_name AS parent, arg_max(p_partkey, (CAST(p_type = 'PROMO' AS INTEGER), -p_partkey)) AS chosen, count(*) - 1 AS siblings FROM part GROUP BY 1")
def er11_parent_rows(spark, d):
    order = F.struct((F.col("p_type") == "PROMO").cast("int"), -F.col("p_partkey"))
    return load(spark, d, "part").groupBy(F.col("p_name").alias("parent")).agg(F.max_by("p_partkey", order).alias("chosen"), (F.count("*") - 1).alias("siblings"))


_EDGES = """(SELECT DISTINCT * FROM (SELECT 'region:' || n_regionkey AS src, 'HAS_NATION' AS type, 'nation:' || n_nationkey AS dst FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'HAS_CUSTOMER', 'customer:' || c_custkey FROM customer
 UNION ALL SELECT 'customer:' || o_custkey, 'PLACED', 'order:' || o_orderkey FROM orders UNION ALL SELECT 'order:' || l_orderkey, 'CONTAINS', 'part:' || l_partkey FROM lineitem))"""


def edges(spark, d) -> DataFrame:
    """The graph of regions, nations, customers, orders and parts."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    n, c, o, li = (load(spark, d, t) for t in ("nation", "customer", "orders", "lineitem"))
    return G.union_edges([
        (n, node("region", "n_regionkey"), "HAS_NATION", node("nation", "n_nationkey")), (c, node("nation", "c_nationkey"), "HAS_CUSTOMER", node("customer", "c_custkey")),
        (o, node("customer", "o_custkey"), "PLACED", node("order", "o_orderkey")), (li, node("order", "l_orderkey"), "CONTAINS", node("part", "l_partkey")),
    ])


@query(f"SELECT src, type, dst FROM {_EDGES}")
def gr01_edges(spark, d):
    return edges(spark, d)


@query("SELECT DISTINCT 'brand:' || p_brand AS head, 'has_type' AS relation, 'type:' || p_type AS tail FROM part")
def gr02_triples(spark, d):
    return load(spark, d, "part").select(F.concat(F.lit("brand:"), "p_brand").alias("head"), F.lit("has_type").alias("relation"), F.concat(F.lit("type:"), "p_type").alias("tail")).distinct()


@query(f"WITH e AS (SELECT * FROM {_EDGES}), a AS (SELECT * FROM e WHERE src = 'region:1' AND type = 'HAS_NATION'), b AS (SELECT * FROM e WHERE type = 'HAS_CUSTOMER' AND src IN (SELECT dst FROM a)), c AS (SELECT * FROM e WHERE type = 'PLACED' AND src IN (SELECT dst FROM b)) SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c")
def gr03_ego(spark, d):
    return G.ego(edges(spark, d), "region:1", ["HAS_NATION", "HAS_CUSTOMER", "PLACED"])


@query("SELECT 'customer:' || c_custkey AS src, 'BACKBONE' AS type, 'nation:' || c_nationkey AS dst FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'BOUGHT', 'part:' || l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 200000")
def gr04_collapsed(spark, d):
    """Evidence nodes collapsed to direct edges, with a fallback edge for what has none."""
    o = load(spark, d, "orders").where("o_totalprice > 200000")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    direct = o.join(load(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(node("customer", "o_custkey").alias("src"), F.lit("BOUGHT").alias("type"), node("part", "l_partkey").alias("dst")).distinct()
    rest = load(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return rest.select(node("customer", "c_custkey").alias("src"), F.lit("BACKBONE").alias("type"), node("nation", "c_nationkey").alias("dst")).unionByName(direct)


@query(f"WITH e AS (SELECT * FROM {_EDGES}) SELECT 'out' AS direction, type, dst AS node FROM e WHERE src = 'customer:7' UNION ALL SELECT 'in', type, src FROM e WHERE dst = 'customer:7'")
def gr05_neighbours(spark, d):
    return G.neighbours(edges(spark, d), "customer:7")


@query(f"WITH e AS (SELECT * FROM {_EDGES}) SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1")
def gr05_degrees(spark, d):
    return G.degrees(edges(spark, d))


@query(f"SELECT type, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM {_EDGES} GROUP BY 1")
def gr06_summary(spark, d):
    return G.summary(edges(spark, d))


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey > 4 ORDER BY c_custkey LIMIT 100")
def gr07_limited(spark, d):
    c = load(spark, d, "customer").orderBy("c_custkey").limit(100)
    return c.join(load(spark, d, "nation").where("n_nationkey > 4"), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("name"))


@query(f"WITH e AS (SELECT * FROM {_EDGES}) SELECT DISTINCT a.src AS n0, b.dst AS n2 FROM e a JOIN e b ON a.dst = b.src WHERE a.type = 'HAS_NATION' AND b.type = 'HAS_CUSTOMER'")
def gr08_two_hops(spark, d):
    return G.path(edges(spark, d), ["HAS_NATION", "HAS_CUSTOMER"]).select("n0", "n2").distinct()


@query("WITH x AS (SELECT s_suppkey, upper(s_name) AS n, s_nationkey FROM supplier) SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'direct' WHEN contains(n, '7') THEN 'substring' ELSE 'none' END AS rule, CASE WHEN s_nationkey < 5 THEN n_name WHEN contains(n, '7') THEN (SELECT min(n_name) FROM nation) END AS mapped FROM x JOIN nation ON n_nationkey = s_nationkey")
def gr09_mapping_ladder(spark, d):
    n = load(spark, d, "nation")
    x = load(spark, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).crossJoin(F.broadcast(n.agg(F.min("n_name").alias("least"))))
    direct, sub = F.col("s_nationkey") < 5, F.upper("s_name").contains("7")
    return x.select("s_suppkey", F.when(direct, "direct").when(sub, "substring").otherwise("none").alias("rule"), F.when(direct, F.col("n_name")).when(sub, F.col("least")).alias("mapped"))


@query("SELECT p_name, arg_max(p_brand, p_partkey) AS p_brand, max(p_partkey) AS p_partkey FROM part GROUP BY 1")
def snk12_node_merge(spark, d):
    p = load(spark, d, "part").select("p_name", "p_brand", "p_partkey")
    return G.merge_nodes(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "p_name", "p_partkey")


@query(f"SELECT split_part(src, ':', 1) AS name, count(DISTINCT src) AS rows FROM {_EDGES} GROUP BY 1")
def ag28_label_counts(spark, d):
    e = edges(spark, d)
    kinds = {k: e.where(F.split("src", ":")[0] == k).select("src").distinct() for k in ("region", "nation", "customer", "order")}
    return counts(kinds)


@query("SELECT p_partkey, 'part_' || substr(sha1(lower(trim(p_name))), 1, 16) AS canonical_id FROM part")
def er_canonical_ids(spark, d):
    return load(spark, d, "part").select("p_partkey", X.stable_id("part", F.col("p_name")).alias("canonical_id"))
