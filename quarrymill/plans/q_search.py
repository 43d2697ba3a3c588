"""Queries of text search, context assembly and the service's views (FT, RA, AP)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import search as S
from ..operators.relational import first_by
from ..operators.shared import folder
from ..sources.tables import load, sql
from ..streaming import runs
from .registry import query

_STOP = "(" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + ")"
_TOKENS = f"list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN {_STOP})"


@query("SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, md5(text) AS body, lang FROM documents UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), md5(text), NULL FROM benchmark UNION ALL SELECT 'turn', conv_id || '/' || turn, md5(text), NULL FROM conversations UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), md5(html), NULL FROM pages")
def ft01_documents(spark, d):
    one = lambda t, kind, id_, body, *more: load(spark, d, t).select(F.lit(kind).alias("kind"), id_.cast("string").alias("id"), F.md5(body).alias("body"), *more)
    parts = [one("documents", "document", F.col("doc_id"), "text", "lang"), one("benchmark", "benchmark", F.col("item_id"), "text"), one("conversations", "turn", F.concat_ws("/", "conv_id", "turn"), "text"), one("pages", "page", F.col("page_id"), "html")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), s AS (SELECT doc_id, len(w) AS l, len(list_filter(w, lambda x: x = 'license')) AS a, len(list_filter(w, lambda x: x = 'licensed')) AS b FROM t), g AS (SELECT count(*) AS n, avg(l) AS al, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM s)
 SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / al)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / al)), 5)::DOUBLE AS score FROM s, g WHERE a > 0 AND b > 0""")
def ft02_bm25(spark, d):
    out = S.search(load(spark, d, "documents"), "doc_id", {"text": 1.0}, "licensed License")
    return out.select("doc_id", F.round("score", 5).alias("score"))


@query(f"""WITH {", ".join(f"{c} AS (SELECT page_id, len(w) AS l, len(list_filter(w, lambda x: x = 'html')) AS a FROM (SELECT page_id, {_TOKENS.replace('text', c)} AS w FROM pages)), {c}_g AS (SELECT count(*) AS n, avg(l) AS al, count(*) FILTER (WHERE a > 0) AS d FROM {c}), {c}_s AS (SELECT page_id, {b} * ln(1 + (n - d + 0.5) / (d + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / al)) AS score FROM {c}, {c}_g WHERE a > 0)" for c, b in (("url", 3.0), ("html", 1.0)))}
 SELECT page_id, round(max(score), 5)::DOUBLE AS score FROM (SELECT * FROM url_s UNION ALL SELECT * FROM html_s) GROUP BY 1""")
def ft02_best_field(spark, d):
    """The best of several boosted fields."""
    out = S.search(load(spark, d, "pages"), "page_id", {"url": 3.0, "html": 1.0}, "html")
    return out.select("page_id", F.round("score", 5).alias("score"))


_ASKED = f"SELECT item_id, list_distinct(w[3:4]) AS w FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark)"


@query(f"""WITH q AS ({_ASKED}), a AS (SELECT item_id, len(w) AS m, unnest(w) AS term FROM q), t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), g AS (SELECT count(*) AS n, avg(len(w)) AS al FROM t),
 p AS (SELECT doc_id, term, any_value(l) AS l, count(*) AS tf FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM a) GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 6)::DOUBLE AS score FROM a JOIN p USING (term) JOIN d USING (term), g GROUP BY item_id, doc_id, m HAVING count(*) = m)
 SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def ft02_indexed(spark, d):
    """Ten documents for each benchmark item, sought by its third and fourth word in a kept index."""
    items = load(spark, d, "benchmark").select("item_id", F.array_join(F.slice(S.analyze(F.col("text")), 3, 2), " ").alias("q"))
    return S.top(S.build(load(spark, d, "documents"), "doc_id", {"text": 1.0}, buckets=16), items, "item_id", "q", 10)


@query("SELECT doc_id, CASE WHEN strpos(lower(text), 'license') > 0 THEN substr(text, greatest(strpos(lower(text), 'license') - 20, 1), 47) ELSE substr(text, 1, 40) END AS snippet FROM documents")
def ft03_snippets(spark, d):
    return load(spark, d, "documents").select("doc_id", S.snippet(F.col("text"), "license", 20).alias("snippet"))


@query("SELECT lang, source, max(n_chars) AS score, arg_max(CAST(doc_id AS VARCHAR), (n_chars, CAST(doc_id AS VARCHAR))) AS best_source, string_agg(DISTINCT CAST(doc_id AS VARCHAR), '|' ORDER BY CAST(doc_id AS VARCHAR)) AS sources, count(*) AS hits FROM documents WHERE n_chars > 3000 GROUP BY 1, 2")
def ft04_collapse(spark, d):
    hits = load(spark, d, "documents").where("n_chars > 3000").withColumn("id", F.col("doc_id").cast("string"))
    return S.collapse(hits, ["lang", "source"], "n_chars", "id")


@query(f"SELECT item_id, array_to_string({_TOKENS}, ' ') AS tokens FROM benchmark")
def ft05_analyzer(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.array_join(S.analyze(F.col("text")), " ").alias("tokens"))


@query("SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(" + _TOKENS + ") AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def snk14_inverted_index(spark, d):
    return S.index(load(spark, d, "documents"), "doc_id", {"text": 1.0}).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("WITH e AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1), b AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) SELECT doc_id, lang, coalesce(n, 0) AS evidence, CASE WHEN n IS NOT NULL AND n_chars > 1000 THEN 'ready' WHEN n IS NOT NULL THEN 'partial' ELSE 'no_evidence' END AS status FROM documents LEFT JOIN e USING (doc_id) LEFT JOIN b USING (doc_id)")
def ra01_context(spark, d):
    e = load(spark, d, "labels").groupBy("doc_id").agg(F.count("*").alias("n"))
    j = load(spark, d, "documents").join(e, "doc_id", "left")
    has = F.col("n").isNotNull()
    return j.select("doc_id", "lang", F.coalesce("n", F.lit(0)).alias("evidence"), F.when(has & (F.col("n_chars") > 1000), "ready").when(has, "partial").otherwise("no_evidence").alias("status"))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'licen') THEN 'license' WHEN contains(lower(text), 'que') OR contains(lower(text), 'the') THEN 'general' ELSE 'fallback' END AS route FROM conversations WHERE role = 'user'")
def ra02_routes(spark, d):
    rules = [("license", ["licen"]), ("general", ["que", "the"])]
    return load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", X.first_keyword(F.col("text"), rules, "fallback").alias("route"))


def candidates(spark, d, group: int, limit: int, offset: int = 0) -> DataFrame:
    """Paged candidates of a group, as a parameterised statement."""
    text = "SELECT p_partkey, p_name, round(sum(l_extendedprice), 2) AS score FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE s_nationkey = :g GROUP BY ALL ORDER BY score DESC NULLS LAST, p_partkey LIMIT :n OFFSET :o"
    return sql(spark, d, text, ["lineitem", "supplier", "part"], g=group, n=max(1, min(limit, 500)), o=max(0, offset))


@query("SELECT p_partkey, p_name, round(sum(l_extendedprice), 2) AS score FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE s_nationkey = 3 GROUP BY ALL ORDER BY score DESC NULLS LAST, p_partkey LIMIT 20 OFFSET 10")
def ap01_candidates(spark, d):
    return candidates(spark, d, 3, 20, 10)


@query("SELECT n_name, r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation JOIN region ON r_regionkey = n_regionkey")
def ap01_group_list(spark, d):
    count = lambda t, k: load(spark, d, t).groupBy(F.col(k).alias("n_nationkey")).agg(F.count("*").alias(f"{t}s"))
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return n.join(count("customer", "c_nationkey"), "n_nationkey", "left").join(count("supplier", "s_nationkey"), "n_nationkey", "left").na.fill(0).select("n_name", "r_name", "customers", "suppliers")


@query("SELECT p_partkey, p_name, p_brand, count(l_orderkey) AS orders, round(coalesce(sum(l_extendedprice), 0), 2) AS revenue FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_partkey = 42 GROUP BY ALL")
def ap01_detail(spark, d):
    p = load(spark, d, "part").where("p_partkey = 42").join(load(spark, d, "lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return p.groupBy("p_partkey", "p_name", "p_brand").agg(F.count("l_orderkey").alias("orders"), F.round(F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)), 2).alias("revenue"))


@query("SELECT user_id, max_by(event_type, event_id) AS status, count(*) AS events, min(ts) AS started, max(ts) AS updated FROM events GROUP BY 1")
def ap02_run_states(spark, d):
    """The state of each run from its log: the last event wins."""
    return load(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("updated"))


@query("SELECT event_id, event_type, value FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 10")
def ap02_run_events(spark, d):
    return load(spark, d, "events").where("user_id = 7").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "event_type", "value")


@query("SELECT lang, doc_id, rn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3")
def ap01_bundle(spark, d):
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return load(spark, d, "documents").select("lang", "doc_id", F.row_number().over(w).alias("rn")).where("rn <= 3")


@query("SELECT doc_id, quality, toxic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, toxic) AS rn FROM labels) WHERE rn = 1")
def ap01_latest_labels(spark, d):
    return first_by(load(spark, d, "labels"), ["doc_id"], F.desc("quality"), F.asc("toxic")).select("doc_id", "quality", "toxic")


@query("SELECT grp, item_id, score FROM (SELECT s_nationkey AS grp, l_partkey AS item_id, round(sum(l_extendedprice), 2) AS score FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) WHERE grp = 5 ORDER BY score DESC, item_id LIMIT 100 OFFSET 20")
def ap01_final_candidates(spark, d):
    """A page of a group's final candidates."""
    li = load(spark, d, "lineitem").join(load(spark, d, "supplier").where("s_nationkey = 5"), F.col("s_suppkey") == F.col("l_suppkey"))
    agg = li.groupBy(F.col("s_nationkey").alias("grp"), F.col("l_partkey").alias("item_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("score"))
    return agg.orderBy(F.desc("score"), "item_id").offset(20).limit(100)


@query("""WITH s AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS ready, count(*) AS n FROM orders GROUP BY 1)
 SELECT c_mktsegment AS grp, count(*) AS targets, CAST(sum(coalesce(n, 0)) AS BIGINT) AS structures, CASE WHEN bool_or(coalesce(ready, false)) THEN 'available' WHEN bool_or(coalesce(n, 0) > 0) THEN 'pending' ELSE 'not_loaded' END AS status FROM customer LEFT JOIN s ON o_custkey = c_custkey GROUP BY 1""")
def ap01_structure_targets(spark, d):
    """Targets of each group with the status that their structures roll up to."""
    s = load(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("ready"), F.count("*").alias("n"))
    j = load(spark, d, "customer").join(s, F.col("o_custkey") == F.col("c_custkey"), "left").na.fill(0, ["n"]).na.fill(False, ["ready"])
    status = F.when(F.bool_or("ready"), "available").when(F.bool_or(F.col("n") > 0), "pending").otherwise("not_loaded")
    return j.groupBy(F.col("c_mktsegment").alias("grp")).agg(F.count("*").alias("targets"), F.sum("n").alias("structures"), status.alias("status"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND lower(c_name) LIKE '%00001%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def ap01_structures(spark, d):
    """Structures of a group whose target matches a text."""
    text = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = :g AND lower(c_name) LIKE concat('%', :q, '%') ORDER BY o_totalprice DESC, o_orderkey LIMIT :n"
    return sql(spark, d, text, ["orders", "customer"], g="BUILDING", q="00001", n=50)


@query("SELECT o_orderkey, c_name, c_mktsegment, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey = 7")
def ap01_structure_detail(spark, d):
    o = load(spark, d, "orders").where("o_orderkey = 7").join(load(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return o.join(load(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey", "c_name", "c_mktsegment", "n_name")


@query("SELECT n_name, (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = n_nationkey) AS candidates, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS targets, CASE WHEN n_nationkey < 20 THEN 'complete' ELSE 'partial' END AS status FROM nation")
def ap01_context(spark, d):
    """Counts that explain a group; a group without a source of its own is partial."""
    c = load(spark, d, "lineitem").join(load(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_distinct("l_partkey").alias("candidates"))
    t = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("targets"))
    out = load(spark, d, "nation").join(c, "n_nationkey", "left").join(t, "n_nationkey", "left").na.fill(0, ["candidates", "targets"])
    return out.select("n_name", "candidates", "targets", F.when(F.col("n_nationkey") < 20, "complete").otherwise("partial").alias("status"))


@query("SELECT event_id AS artifact_id, event_type AS kind, props FROM events WHERE user_id = 7 AND event_type <> 'view' ORDER BY ts, event_id")
def ap02_run_artifacts(spark, d):
    """Artifacts of one run in the order they came."""
    return load(spark, d, "events").where("user_id = 7 AND event_type <> 'view'").orderBy("ts", "event_id").select(F.col("event_id").alias("artifact_id"), F.col("event_type").alias("kind"), "props")


_RUNS = "(SELECT user_id AS run_id, max_by(event_type, event_id) AS status FROM events GROUP BY 1)"


def _changed(spark, d, allowed, status):
    """Runs in one of the allowed states as a change of state leaves them; all others stay, with the reason."""
    runs = load(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.max_by("event_type", "event_id").alias("status"))
    ok = F.col("status").isin(*allowed)
    return runs.select("run_id", F.when(ok, status).otherwise(F.col("status")).alias("status"), F.when(~ok, F.concat(F.lit("cannot change from "), "status")).alias("refused"))


@query(f"SELECT run_id, CASE WHEN status IN ('view', 'click') THEN 'cancelled' ELSE status END AS status, CASE WHEN status NOT IN ('view', 'click') THEN 'cannot change from ' || status END AS refused FROM {_RUNS}")
def ap02_cancel(spark, d):
    return _changed(spark, d, ("view", "click"), "cancelled")


@query(f"SELECT run_id, CASE WHEN status IN ('purchase') THEN 'completed' ELSE status END AS status, CASE WHEN status NOT IN ('purchase') THEN 'cannot change from ' || status END AS refused FROM {_RUNS}")
def ap02_complete(spark, d):
    return _changed(spark, d, ("purchase",), "completed")


_OK = "((s = '' AND x IN ('signup', 'view')) OR (s = 'signup' AND x = 'view') OR (s = 'view' AND x IN ('view', 'click')) OR (s = 'click' AND x IN ('view', 'click', 'purchase')) OR (s = 'purchase' AND x = 'view'))"


@query(f"""WITH e AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS k, list(event_id ORDER BY ts, event_id) AS ids FROM events GROUP BY 1), i AS (SELECT *, unnest(range(1, len(k) + 1)) AS i FROM e),
 r AS (SELECT user_id, ids[i] AS event_id, k[i] AS x, list_reduce(list_prepend('', k[1:i - 1]), lambda s, x: CASE WHEN {_OK} THEN x ELSE s END) AS s FROM i)
 SELECT user_id, event_id, x AS event_type, s AS before, CASE WHEN {_OK} THEN x ELSE s END AS status, CASE WHEN {_OK} THEN 'accepted' ELSE 'refused' END AS outcome FROM r""")
def ap02_transitions(spark, d):
    """The log as a stream of changes of state, of which some are refused."""
    top = folder(spark)
    load(spark, d, "events").write.parquet(f"{top}/events")
    changes = runs.transitions(runs.event_stream(spark, f"{top}/events", files=1_000_000))  # one batch, so events are taken in the order of their times
    runs.write(changes, f"{top}/changes", f"{top}/state").awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{top}/changes").where("outcome <> 'stuck'").drop("ts")
