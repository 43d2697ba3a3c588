"""Queries of the scalar functions (SC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..operators.relational import when_chain
from ..sources.tables import load
from .registry import query


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS name FROM part")
def sc01_normalize_name(spark, d):
    return load(spark, d, "part").select("p_partkey", X.normalize_name(F.col("p_name")).alias("name"))


@query("SELECT p_partkey, nullif(regexp_replace(regexp_replace(p_type || '/' || p_brand, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '') AS feature FROM part")
def sc02_feature_name(spark, d):
    return load(spark, d, "part").select("p_partkey", X.feature_name(F.concat_ws("/", "p_type", "p_brand")).alias("feature"))


@query("SELECT p_partkey, trim(regexp_replace(p_name || ' (' || p_size || ')', ' *\\([0-9]+\\)$', '')) AS name FROM part")
def sc03_strip_suffix(spark, d):
    return load(spark, d, "part").select("p_partkey", X.strip_numeric_suffix(F.concat("p_name", F.lit(" ("), "p_size", F.lit(")"))).alias("name"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_md5 FROM documents")
def sc04_collapse_spaces(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(X.collapse_spaces(F.col("text"))).alias("text_md5"))


@query("SELECT c_custkey, CASE WHEN lower(trim(coalesce(m, ''))) IN ('', 'nan', 'none', 'null', 'na', 'n/a') THEN '' ELSE trim(m) END AS segment FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' NaN ' WHEN 2 THEN 'N/A' ELSE ' ' || c_mktsegment END AS m FROM customer)")
def sc05_null_words(spark, d):
    k = F.col("c_custkey") % 5
    raw = F.when(k == 0, F.lit(None)).when(k == 1, " NaN ").when(k == 2, "N/A").otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    return load(spark, d, "customer").select("c_custkey", X.null_words_to_empty(raw).alias("segment"))


@query("""SELECT p_partkey, 'item_' || substr(sha1(lower(trim(p_name)) || '|' || lower(trim(p_brand))), 1, 16) AS id_folded,
 'item_' || substr(sha1(p_name || '||' || p_brand), 1, 16) AS id_exact, 'item_' || substr(sha1(p_name || '::' || p_brand), 1, 16) AS id_colon FROM part""")
def sc06_stable_ids(spark, d):
    name, brand = F.col("p_name"), F.col("p_brand")
    return load(spark, d, "part").select(
        "p_partkey", X.stable_id("item", name, brand).alias("id_folded"),
        X.stable_id("item", name, brand, separator="||", fold=False).alias("id_exact"), X.stable_id("item", name, brand, separator="::", fold=False).alias("id_colon"),
    )


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sc07_sha256(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(s, '[,;/|]+|\\band\\b'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) NOT IN ('none')))), '|') AS terms
 FROM (SELECT p_partkey, p_type || '; ' || p_brand || ' and none, ' || p_type AS s FROM part)""")
def sc08_term_set(spark, d):
    text = F.concat("p_type", F.lit("; "), "p_brand", F.lit(" and none, "), "p_type")
    return load(spark, d, "part").select("p_partkey", F.array_join(X.term_set(text, ["none"]), "|").alias("terms"))


@query("""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS i FROM benchmark),
 u AS (SELECT item_id, w, min(i) AS i FROM t WHERE w NOT IN ('the', 'of', 'and') GROUP BY ALL)
 SELECT item_id, string_agg(w, ' ' ORDER BY i) AS tokens FROM u GROUP BY item_id""")
def sc09_ordered_tokens(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.array_join(X.tokens(F.col("text"), stop=["the", "of", "and"]), " ").alias("tokens")).where("tokens <> ''")


@query("SELECT p_partkey, coalesce(regexp_matches(upper(replace(p_brand, '#', '-')), '^[A-Z0-9-]+$'), false) AS symbol FROM part")
def sc10_symbol_like(spark, d):
    return load(spark, d, "part").select("p_partkey", X.symbol_like(F.upper(F.replace("p_brand", F.lit("#"), F.lit("-")))).alias("symbol"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN p_type || ', ' || p_brand WHEN 2 THEN upper(replace(p_brand, '#', '')) WHEN 3 THEN p_type || ' signaling' ELSE p_name END AS s FROM part)
 SELECT p_partkey, CASE WHEN lower(trim(s)) IN ('', 'nan', 'none', 'null', 'na', 'n/a', 'unknown', '-') THEN 'placeholder' WHEN regexp_matches(s, '[,;|]') THEN 'multi' WHEN regexp_matches(trim(s), '^[A-Z0-9-]+$') THEN 'symbol'
 WHEN regexp_matches(lower(s), 'pathway|signaling|signalling') THEN 'pathway' ELSE 'free_text' END AS class FROM t""")
def sc11_text_class(spark, d):
    k = F.col("p_partkey") % 5
    s = F.when(k == 0, "unknown").when(k == 1, F.concat("p_type", F.lit(", "), "p_brand")).when(k == 2, F.upper(F.replace("p_brand", F.lit("#"), F.lit("")))).when(k == 3, F.concat("p_type", F.lit(" signaling"))).otherwise(F.col("p_name"))
    return load(spark, d, "part").select("p_partkey", X.text_class(s).alias("class"))


@query("SELECT c_custkey, nullif(regexp_extract(c_name, '#?0*([1-9][0-9]*)$', 1), '') AS code FROM customer")
def sc12_extract_code(spark, d):
    return load(spark, d, "customer").select("c_custkey", X.extract(F.col("c_name"), "#?0*([1-9][0-9]*)$").alias("code"))


@query("SELECT p_partkey, trim(x) AS term FROM (SELECT p_partkey, unnest(string_split_regex(p_name || '; ' || p_brand || ' and ' || p_type, '[;,]| and ')) AS x FROM part) WHERE trim(x) <> ''")
def sc13_list_rows(spark, d):
    text = F.concat("p_name", F.lit("; "), "p_brand", F.lit(" and "), "p_type")
    return load(spark, d, "part").select("p_partkey", F.explode(F.split(text, "[;,]| and ")).alias("x")).select("p_partkey", F.trim("x").alias("term")).where("term <> ''")


@query("SELECT n_nationkey, unnest(string_split(n_name || '|' || r_name, '|')) AS part FROM nation JOIN region ON n_regionkey = r_regionkey")
def sc14_pipe_rows(spark, d):
    j = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("n_nationkey", F.explode(F.split(F.concat_ws("|", "n_name", "r_name"), r"\|")).alias("part"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) || '.0' WHEN 1 THEN '' WHEN 2 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS s, event_type FROM events)
 SELECT event_id, TRY_CAST(TRY_CAST(s AS DOUBLE) AS INTEGER) AS i, TRY_CAST(s AS DOUBLE) AS f, lower(trim(event_type)) IN ('true', '1', 'yes', 'y', 't') AS b FROM t""")
def sc15_safe_casts(spark, d):
    k, text = F.col("event_id") % 4, F.col("event_id").cast("string")
    s = F.when(k == 0, F.concat(text, F.lit(".0"))).when(k == 1, "").when(k == 2, "x").otherwise(text)
    return load(spark, d, "events").select("event_id", N.safe_int(s).alias("i"), N.safe_float(s).alias("f"), N.safe_bool(F.col("event_type")).alias("b"))


@query("SELECT event_id, round(greatest(0.0, least(1.0, value / 100.0)), 4)::DOUBLE AS score FROM events")
def sc16_clamp(spark, d):
    return load(spark, d, "events").select("event_id", N.clamp(F.col("value") / 100.0).alias("score"))


@query("SELECT p_partkey, CASE upper(p_type) WHEN 'PROMO' THEN 'promotion' WHEN 'ECONOMY' THEN 'budget' ELSE lower(p_type) END AS alias FROM part")
def sc17_alias_map(spark, d):
    return load(spark, d, "part").select("p_partkey", F.coalesce(X.lookup(F.upper("p_type"), {"PROMO": "promotion", "ECONOMY": "budget"}), F.lower("p_type")).alias("alias"))


@query("SELECT event_id, round(ln(1 + abs(value)), 6) AS log_value, round(1 / (1 + exp(-greatest(-30.0, least(30.0, value / 10)))), 6) AS chance FROM events")
def sc18_log_sigmoid(spark, d):
    v = F.col("value")
    return load(spark, d, "events").select("event_id", F.round(F.log(1 + F.abs(v)), 6).alias("log_value"), F.round(N.sigmoid(v / 10), 6).alias("chance"))


@query("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events WHERE event_id % 5 <> 0 GROUP BY 1)
 SELECT event_id, round((value - m) / CASE WHEN sd < 1e-6 THEN 1.0 ELSE sd END, 6) AS z FROM events JOIN s USING (event_type)""")
def sc19_z_scale(spark, d):
    e = load(spark, d, "events")
    s = e.where("event_id % 5 <> 0").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    return e.join(s, "event_type").select("event_id", F.round((F.col("value") - F.col("m")) / F.when(F.col("sd") < 1e-6, 1.0).otherwise(F.col("sd")), 6).alias("z"))


@query("SELECT o_orderkey, round(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 365.25, 4)::DOUBLE AS years, round(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 30.4375, 4)::DOUBLE AS months FROM orders")
def sc20_days_to_years(spark, d):
    days = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return load(spark, d, "orders").select("o_orderkey", F.round(days / F.lit(365.25), 4).alias("years"), F.round(days / F.lit(30.4375), 4).alias("months"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END AS event FROM orders")
def sc21_status_event(spark, d):
    s = F.col("o_orderstatus")
    return load(spark, d, "orders").select("o_orderkey", F.when(s == "F", 1).when(s == "O", 0).alias("event"))


@query("SELECT o_orderkey, coalesce(nullif(upper(regexp_replace(o_orderpriority, '^[0-9]+-| .*$', '', 'g')), ''), 'UNKNOWN') AS stage FROM orders")
def sc22_stage(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.coalesce(F.nullif(F.upper(F.regexp_replace("o_orderpriority", "^[0-9]+-| .*$", "")), F.lit("")), F.lit("UNKNOWN")).alias("stage"))


@query("SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS row_json FROM nation")
def sc23_row_json(spark, d):
    n = load(spark, d, "nation")
    return n.select("n_nationkey", F.to_json(F.struct(*sorted(n.columns))).alias("row_json"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1")
def sc24_json_extract(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))


@query("SELECT doc_id, CAST((length(text) - length(replace(lower(text), 'the', ''))) // 3 AS BIGINT) AS n FROM documents WHERE lang = 'en'")
def sc25_term_count(spark, d):
    return load(spark, d, "documents").where("lang = 'en'").select("doc_id", X.term_count(F.col("text"), "the").alias("n"))


@query("SELECT p_partkey, trim(regexp_replace(lower(trim(p_name || ' sodium 20mg')), '(\\s+(sodium|[0-9]+mg))+$', '')) AS parent FROM part")
def sc26_parent_name(spark, d):
    return load(spark, d, "part").select("p_partkey", X.parent_name(F.concat("p_name", F.lit(" sodium 20mg")), ["sodium", "[0-9]+mg"]).alias("parent"))


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'warum') OR contains(lower(text), 'why') THEN 'reason' WHEN contains(lower(text), 'the') THEN 'english' WHEN contains(lower(text), 'der') THEN 'german' ELSE 'other' END AS intent FROM conversations""")
def sc27_intent(spark, d):
    rules = [("reason", ["warum", "why"]), ("english", ["the"]), ("german", ["der"])]
    return load(spark, d, "conversations").select("conv_id", "turn", X.first_keyword(F.col("text"), rules, "other").alias("intent"))


@query("SELECT p_partkey, (CASE WHEN p_retailprice > 1500 THEN 1 ELSE 0 END + CASE WHEN p_size > 40 THEN 1 ELSE 0 END + CASE WHEN length(p_name) > 20 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END) AS violations FROM part")
def sc28_violations(spark, d):
    flags = (F.col("p_retailprice") > 1500, F.col("p_size") > 40, F.length("p_name") > 20, F.col("p_partkey") % 7 == 0)
    return load(spark, d, "part").select("p_partkey", N.violations(*flags).alias("violations"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN value >= 50 WHEN 'purchase' THEN value BETWEEN 20 AND 80 ELSE round_even(value / 100, 0) = 1 END AS good FROM events")
def sc29_assay_flag(spark, d):
    v, kind = F.col("value"), F.col("event_type")
    return load(spark, d, "events").select("event_id", when_chain([(kind == "click", v >= 50), (kind == "purchase", v.between(20, 80))], F.bround(v / 100, 0) == 1).alias("good"))


@query("""SELECT p_partkey, length(p_name) AS n_chars, len(list_distinct(list_transform(generate_series(1, greatest(length(p_name) - 2, 0)), lambda i: substr(lower(p_name), CAST(i AS INTEGER), 3)))) AS n_grams FROM part""")
def sc30_gram_fingerprint(spark, d):
    name = F.lower("p_name")
    grams = F.transform(F.sequence(F.lit(1), F.length("p_name") - 2), lambda i: F.substring(name, i, F.lit(3)))
    return load(spark, d, "part").select("p_partkey", F.length("p_name").alias("n_chars"), F.when(F.length("p_name") < 3, 0).otherwise(F.size(F.array_distinct(grams))).alias("n_grams"))
