"""Queries of checks and profiles (VL)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import validate as V
from ..sources.tables import load
from .registry import query


@query("SELECT (SELECT count(*) FROM documents) AS rows_a, (SELECT count(*) FROM labels) AS rows_b, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS missing_in_a, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS missing_in_b, NOT EXISTS (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) AND NOT EXISTS (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) AS same")
def vl01_parity(spark, d):
    return V.parity(load(spark, d, "documents"), load(spark, d, "labels"), "doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)")
def vl02_dangling(spark, d):
    return V.dangling(load(spark, d, "lineitem"), "l_partkey", load(spark, d, "part").where("p_size > 3"), "p_partkey").select("l_orderkey", "l_linenumber")


@query("SELECT * FROM (SELECT 'discount' AS name, count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 0.08)) AS violations, count(*) AS rows FROM lineitem UNION ALL SELECT 'quantity', count(*) FILTER (WHERE NOT l_quantity >= 2), count(*) FROM lineitem UNION ALL SELECT 'flag', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')), count(*) FROM lineitem)")
def vl03_rules(spark, d):
    return V.rules(load(spark, d, "lineitem"), {"discount": F.col("l_discount").between(0, 0.08), "quantity": F.col("l_quantity") >= 2, "flag": F.col("l_returnflag").isin("A", "N")})


@query("SELECT 'nation' AS name, count(*) FILTER (WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 24)) AS broken FROM customer UNION ALL SELECT 'segment', count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer")
def vl04_keys_and_enums(spark, d):
    c = load(spark, d, "customer")
    keys = V.dangling(c, "c_nationkey", load(spark, d, "nation").where("n_nationkey < 24"), "n_nationkey").agg(F.lit("nation").alias("name"), F.count("*").alias("broken"))
    return keys.unionByName(c.agg(F.lit("segment").alias("name"), F.count_if(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).alias("broken")))


@query("SELECT 'text' AS name, count(*) FILTER (WHERE coalesce(trim(text), '') = '') AS missing, count(*) FILTER (WHERE length(text) > 5000) AS long FROM documents UNION ALL SELECT 'source', count(*) FILTER (WHERE coalesce(trim(source), '') = ''), count(*) FILTER (WHERE length(source) > 5000) FROM documents")
def vl05_text_profile(spark, d):
    return V.text_profile(load(spark, d, "documents"), ["text", "source"], 5000)


@query("SELECT 'absent' AS name, 'missing' AS problem UNION ALL SELECT 'p_name', 'is string'")
def vl06_schema(spark, d):
    found = V.schema_report(load(spark, d, "part"), {"p_partkey": "bigint", "p_name": "int", "absent": "string"})
    return spark.createDataFrame(found, "name string, problem string")


@query("SELECT count(*) AS rows, count(DISTINCT doc_id) AS n_unique, round(avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS coverage_quality, round(avg(CASE WHEN toxic IS NOT NULL THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS coverage_toxic, true AS ready FROM labels")
def vl07_readiness(spark, d):
    return V.readiness(load(spark, d, "labels"), "doc_id", ["quality", "toxic"], 0.95)


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS n_null, min(CAST({c} AS VARCHAR)) AS least, max(CAST({c} AS VARCHAR)) AS most, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM customer WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS samples FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def vl08_profile(spark, d):
    return V.profile(load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query("SELECT 'duplicates' AS name, count(*) AS n FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'dangling', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey > 5) UNION ALL SELECT 'hold', count(*) FROM part WHERE p_type IN ('PROMO')")
def vl09_seed_checks(spark, d):
    return _seed_checks(spark, d, load(spark, d, "part"))


def _seed_checks(spark, d, seed):
    found = {
        "duplicates": V.duplicates(seed, ["p_name"]),
        "dangling": V.dangling(load(spark, d, "lineitem"), "l_suppkey", load(spark, d, "supplier").where("s_suppkey > 5"), "s_suppkey"),
        "hold": seed.where(F.col("p_type").isin("PROMO")),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in found.items()])
