"""Queries of readers and writers (SRC, SNK): tables go out in a format and come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import folder
from ..sources import sinks
from ..sources import tables as T
from ..sources.tables import load
from .registry import query


_NATION = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation"


@query(_NATION)
def src01_csv(spark, d):
    path = f"{folder(spark)}/nation.csv"
    sinks.write_csv(load(spark, d, "nation"), path, ["n_nationkey", "n_name"])
    return T.read_any(spark, path)


@query("SELECT n_nationkey, n_name FROM nation")
def src02_tsv_gz(spark, d):
    path = f"{folder(spark)}/nation.tsv.gz"
    sinks.write_csv(load(spark, d, "nation"), path, ["n_nationkey", "n_name"], "\t", gzip=True)
    return T.read_any(spark, path, "n_nationkey int, n_name string")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 40")
def src03_parquet_columns(spark, d):
    return T.read_any(spark, f"{d}/part.parquet").where("p_size > 40").select("p_partkey", "p_size")


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def src04_parquet_folder(spark, d):
    path = f"{folder(spark)}/orders.parquet"
    sinks.write_parquet(load(spark, d, "orders"), path, ["o_orderstatus"])
    return T.read_any(spark, path).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT 'c_mktsegment=' || c_mktsegment AS source_part, count(*) AS n FROM customer GROUP BY 1")
def src05_parts(spark, d):
    root = folder(spark)
    sinks.write_parquet(load(spark, d, "customer"), f"{root}/a/customer", ["c_mktsegment"])
    return T.read_parts(spark, root, "*.parquet").groupBy("source_part").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_brand FROM part")
def src06_one_column(spark, d):
    return T.read_any(spark, f"{d}/part.parquet").select("p_brand").distinct()


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def src07_preamble(spark, d):
    path = f"{folder(spark)}/region.csv"
    rows = load(spark, d, "region").select(F.concat_ws(",", "r_regionkey", "r_name").alias("value"), F.col("r_regionkey").alias("o"))
    head = spark.createDataFrame([("# made by a machine", -3), ("# on no day", -2), ("r_regionkey,r_name", -1)], "value string, o int")
    head.unionByName(rows).orderBy("o").coalesce(1).select("value").write.text(path)
    return T.read_any(spark, path, comment="#")


@query("SELECT doc_id FROM documents WHERE n_chars > 4000 AND lang = 'de'")
def src08_scan_filter(spark, d):
    return load(spark, d, "documents").where("n_chars > 4000 AND lang = 'de'").select("doc_id")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n FROM pages")
def src_pages_html(spark, d):
    return load(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").alias("n"))


@query("SELECT s_suppkey, s_name FROM supplier")
def src11_xml(spark, d):
    path = f"{folder(spark)}/supplier.xml"
    load(spark, d, "supplier").select("s_suppkey", "s_name").write.format("xml").option("rootTag", "suppliers").option("rowTag", "supplier").save(path)
    return T.read_xml(spark, path, "supplier", "s_suppkey long, s_name string")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def src12_jdbc(spark, d):
    """A join that databases run, one for each range of the customers' keys."""
    c, n = load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), load(spark, d, "nation").select("n_nationkey", "n_name")
    joined = 'SELECT c."c_custkey", c."c_name", n."n_name" FROM customer c JOIN nation n ON n."n_nationkey" = c."c_nationkey"'
    return T.read_derby_shards(spark, c, "customer", {"nation": n}, joined, "c_custkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS first_tag, greatest(value, 1.0)::DOUBLE AS most FROM events")
def src16_nested_json(spark, d):
    path = f"{folder(spark)}/events.json"
    nested = load(spark, d, "events").select("event_id", "props", F.array("event_type").alias("tags"), F.array(F.struct(F.col("value").alias("v")), F.struct(F.lit(1.0).alias("v"))).alias("values"))
    sinks.write_json(nested, path)
    rows = T.read_any(spark, path, "event_id long, props string, tags array<string>, values array<struct<v double>>")
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.element_at("tags", 1).alias("first_tag"), F.array_max(F.transform("values", lambda x: x["v"])).alias("most"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def src17_pipe_tables(spark, d):
    rows = load(spark, d, "nation").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("| "), x["n_nationkey"].cast("string"), F.lit(" | "), x["n_name"], F.lit(" |"))), "\n").alias("t"))
    text = rows.select(F.lit(1).alias("doc"), F.concat(F.lit("# Report\n\n| id | name |\n| --- | --- |\n"), "t", F.lit("\n| ragged |\n\nend")).alias("text"))
    cells = T.pipe_tables(text, "doc", "text").where("row_no > 0")
    return cells.select(F.col("cells")[0].alias("id"), F.col("cells")[1].alias("name"))


@query("SELECT s_nationkey AS doc, CAST(s_suppkey AS VARCHAR) AS x, s_name AS y FROM supplier")
def src18_csv_after_heading(spark, d):
    """A report for each nation, with its suppliers as CSV below a heading, read back."""
    lines = F.array_join(F.sort_array(F.collect_list(F.concat_ws(", ", "s_suppkey", "s_name"))), "\n")
    text = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("doc")).agg(F.concat(F.lit("intro\n## Links\nx,y\n"), lines, F.lit("\nno table\n## Next\nc, 3\n")).alias("text"))
    return T.csv_after_heading(text, "doc", "text", "Links").where("row_no > 0").select("doc", F.col("cells")[0].alias("x"), F.col("cells")[1].alias("y"))


@query("SELECT count(*) AS n FROM region")
def src19_fallback(spark, d):
    return spark.read.parquet(T.first_existing(spark, [f"{d}/absent.parquet", f"{d}/region.parquet"])).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000")
def src21_sql(spark, d):
    return T.sql(spark, d, "SELECT count(*) AS n FROM orders WHERE o_orderstatus = :s AND o_totalprice >= :p", ["orders"], s="F", p=1000)


@query()
def src24_listing(spark, d) -> DataFrame:
    """Files of the tables' folder, by name and size."""
    return T.listing(spark, d, [".parquet"]).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query(_NATION)
def snk04_json_lines(spark, d):
    path = f"{folder(spark)}/nation.json"
    sinks.write_json(load(spark, d, "nation"), path)
    return T.read_any(spark, path, "n_nationkey string, n_name string")


@query("SELECT '| 0 |' AS line")
def snk05_markdown(spark, d):
    text = sinks.markdown(load(spark, d, "region").orderBy("r_regionkey").select("r_regionkey"))
    return spark.createDataFrame([(text.split("\n")[2],)], "line string")


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 4) AS first FROM embeddings")
def snk15_vectors(spark, d):
    path = f"{folder(spark)}/vectors.parquet"
    sinks.write_parquet(load(spark, d, "embeddings"), path)
    return T.read_any(spark, path).select("vec_id", F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))


@query("SELECT 'nation' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def src20_by_suffix(spark, d):
    """Parquet, tab-separated and JSON tables through the one reader."""
    root = folder(spark)
    sinks.write_csv(load(spark, d, "nation"), f"{root}/nation.tsv", ["n_name"], "\t")
    sinks.write_json(load(spark, d, "region"), f"{root}/region.jsonl")
    one = lambda path, kind, schema: T.read_any(spark, path, schema).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return one(f"{root}/nation.tsv", "nation", "n_name string").unionByName(one(f"{root}/region.jsonl", "region", "r_name string"))


@query("SELECT 'nation:' || n_nationkey AS node, 'region:' || n_regionkey AS other FROM nation")
def src22_graph_pattern(spark, d):
    """(region)-[HAS_NATION]->(nation), read from tables of edges."""
    e = load(spark, d, "nation").select(F.concat(F.lit("region:"), "n_regionkey").alias("src"), F.lit("HAS_NATION").alias("type"), F.concat(F.lit("nation:"), "n_nationkey").alias("dst"))
    return e.where("type = 'HAS_NATION'").select(F.col("dst").alias("node"), F.col("src").alias("other"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def src23_cached_small(spark, d):
    n = load(spark, d, "nation").cache()
    return load(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name")


@query("SELECT count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS keys FROM (SELECT * FROM supplier UNION ALL SELECT * FROM supplier WHERE s_acctbal < 0)")
def snk07_append(spark, d):
    path, s = f"{folder(spark)}/supplier.parquet", load(spark, d, "supplier")
    sinks.write_parquet(s, path)
    s.where("s_acctbal < 0").write.mode("append").parquet(path)
    return T.read_any(spark, path).agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"))


@query("SELECT count(*) AS n FROM region")
def snk06_reload(spark, d):
    """Empty a table and load it anew: the later overwrite is all that stays."""
    path = f"{folder(spark)}/region.parquet"
    sinks.write_parquet(load(spark, d, "nation"), path)
    sinks.write_parquet(load(spark, d, "region"), path)
    return T.read_any(spark, path).agg(F.count("*").alias("n"))


@query("SELECT 'tables/region.csv' AS member, r_regionkey AS line_no, r_regionkey || ',' || r_name AS line FROM region")
def src09_archive(spark, d):
    """Lines of the members of a zip archive that match a pattern."""
    import io
    import zipfile

    lines = [f"{r.r_regionkey},{r.r_name}" for r in load(spark, d, "region").orderBy("r_regionkey").collect()]  # five rows
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("tables/region.csv", "\n".join(lines))
        z.writestr("tables/readme.txt", "left out")
    path = f"{folder(spark)}/tables.zip"
    T.put_bytes(spark, path, held.getvalue())
    return T.archive_members(spark, path, r"\.csv$")


@query("SELECT n_nationkey::BIGINT AS row_no, [n_nationkey::DOUBLE, n_regionkey::DOUBLE] AS \"values\" FROM nation")
def src14_npy(spark, d):
    """A matrix out of a .npy file."""
    import io

    import numpy as np

    rows = load(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 rows
    held = io.BytesIO()
    np.save(held, np.array([(r.n_nationkey, r.n_regionkey) for r in rows]))
    path = f"{folder(spark)}/nation.npy"
    T.put_bytes(spark, path, held.getvalue())
    return T.read_npy(spark, path)


@query("SELECT 'insert' AS change, s_suppkey + 1000000 AS s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'update', s_suppkey, 0.0 FROM supplier WHERE s_acctbal < 0")
def snk11_returning(spark, d):
    """Rows that an insert and an update changed, as the new versions of the table hold them."""
    s = load(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    new = s.where("s_acctbal < 0").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), "s_acctbal")
    inserted = sinks.insert_returning(s, new, f"{folder(spark)}/inserted.parquet")
    updated = sinks.update_returning(s, F.col("s_acctbal") < 0, {"s_acctbal": F.lit(0.0)}, f"{folder(spark)}/updated.parquet")
    return inserted.select(F.lit("insert").alias("change"), "*").unionByName(updated.select(F.lit("update").alias("change"), "*"))
