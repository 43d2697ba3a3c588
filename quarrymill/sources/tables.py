"""Readers: by suffix, by folder, by fallback, and of semi-structured text."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import folder

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Rows of each embedded database.
SHARD_ROWS = 1 << 18


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder. Columns and filters reach the scan by themselves."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: Sequence[str] = NAMES) -> None:
    """Temporary views over the folder's tables, for SQL."""
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)


def sql(spark: SparkSession, folder: str, text: str, names: Sequence[str], **args: object) -> DataFrame:
    """A parameterised statement over the tables."""
    register(spark, folder, names)
    return spark.sql(text, args=args) if args else spark.sql(text)


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None, comment: str | None = None) -> DataFrame:
    """Parquet, JSON lines, XML-free text tables: the reader follows the suffix (.gz aside). Text columns stay text without a schema, '' is null."""
    stem = path.removesuffix(".gz").removesuffix("/")
    if stem.endswith(".parquet"):
        return spark.read.parquet(path)
    if stem.endswith((".json", ".jsonl", ".ndjson")):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    if stem.endswith((".csv", ".tsv", ".txt")):
        reader = spark.read.option("header", True).option("sep", "," if stem.endswith(".csv") else "\t").option("nullValue", "").option("quote", '"').option("escape", '"')
        reader = reader.option("comment", comment) if comment else reader
        return (reader.schema(schema) if schema else reader).csv(path)
    raise ValueError(f"no reader for {path}")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """Rows of an XML file, by Spark's own reader."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_jdbc(spark: SparkSession, url: str, query: str, driver: str, **options: str) -> DataFrame:
    """A query of a database, which runs it; pass partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", driver=driver, **options).load()


def read_jdbc_ranges(spark: SparkSession, url: str, query: str, key: str, parts: int, driver: str, **options: str) -> DataFrame:
    """A query of a database in as many reads, by ranges of a key with about as many rows each, however its values are spread; nulls go with the first.

    The ranges' first keys come from the database: every so-manieth row in the key's order. It counts and numbers the rows itself.
    """
    n = read_jdbc(spark, url, f"SELECT COUNT(*) AS n FROM ({query}) c", driver, **options).first()[0]
    step = max(1, -(-n // max(1, parts)))
    numbered = f"SELECT s.{key} AS k, ROW_NUMBER() OVER () AS r FROM (SELECT {key} FROM ({query}) c WHERE {key} IS NOT NULL ORDER BY {key}) s"
    firsts = read_jdbc(spark, url, f"SELECT DISTINCT k FROM ({numbered}) m WHERE MOD(r, {step}) = 0", driver, **options)
    cuts = sorted(r[0] for r in firsts.collect())  # parts keys
    said = [_literal(c) for c in cuts]
    ranges = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(said, said[1:], strict=False)]
    ranges = [f"{key} < {said[0]} OR {key} IS NULL", *ranges, f"{key} >= {said[-1]}"] if said else ["1 = 1"]
    return spark.read.jdbc(url, f"({query}) q", predicates=ranges, properties={"driver": driver, **options})


def read_derby_shards(spark: SparkSession, parts: DataFrame, name: str, beside: dict[str, DataFrame], query: str, key: str, at_least: int = 4) -> DataFrame:
    """A query that databases run, one for each range of a key of ``parts`` (table ``name``); small tables ``beside`` it are in each of them.

    An embedded Derby database lives in the process that opened it, so none can serve all executors. Each task opens one of its own in its executor, from a
    template that holds the tables (the small ones filled), loads its range of about ``SHARD_ROWS`` rows into it and runs the query there. No row of
    ``parts`` passes the driver. Rows that the query brings together must be of one key, or from the small tables. A database stays in its
    executor's memory until that ends. All processes must see the shared folder as a local path.
    """
    driver, home, held = "org.apache.derby.iapi.jdbc.AutoloadedDriver", local_path(folder(spark)), uuid.uuid4().hex
    n = max(at_least, -(-parts.count() // SHARD_ROWS))
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))  # noqa: E731  a null is not quoted
    lines = lambda df: df.select(F.concat_ws(",", *map(quoted, df.columns)).alias("value"))
    lines(parts.repartitionByRange(n, key)).write.text(f"file://{home}/{name}")
    url = f"jdbc:derby:memory:{held}"
    for table, df in {name: parts, **beside}.items():
        spark.createDataFrame([], df.schema).write.format("jdbc").options(url=f"{url};create=true", dbtable=table, driver=driver).save()
    for table, df in beside.items():
        lines(df.coalesce(1)).write.text(f"file://{home}/{table}")
    files = lambda table: sorted(local_path(r.path) for r in listing(spark, f"file://{home}/{table}", [".txt"]).select("path").collect())
    load_ = lambda table, path: f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table.upper()}', '{path}', NULL, NULL, 'UTF-8', {{}})"
    _derby(spark, url, *(load_(table, path).format(0) for table in beside for path in files(table)), f"CALL SYSCS_UTIL.SYSCS_BACKUP_DATABASE('{home}/template')")
    _derby(spark, f"{url};drop=true")
    out = []
    for i, path in enumerate(files(name) or [None]):
        own = f"jdbc:derby:memory:{held}-{i}"
        start = {"sessionInitStatement": load_(name, path).format(1)} if path else {}  # 1: what a task that runs again finds is replaced
        out.append(read_jdbc(spark, f"{own};createFrom={home}/template/{held}", query, driver, **start))
        _derby(spark, f"{own};drop=true")  # the driver has read the columns there
    return reduce(DataFrame.unionByName, out)


def _derby(spark: SparkSession, url: str, *statements: str) -> None:
    """Run statements in a database of the driver's process, or drop it, which Derby reports as an error of state 08006."""
    connect = spark._jvm.java.sql.DriverManager.getConnection
    if url.endswith(";drop=true"):
        try:
            connect(url)
        except Exception as e:
            if "08006" not in (state := str(e.java_exception.getSQLState()) if hasattr(e, "java_exception") else str(e)):
                raise RuntimeError(f"{url}: {state}") from e
        return
    held = connect(url)
    try:
        for text in statements:
            held.createStatement().execute(text)
    finally:
        held.close()


def local_path(uri: str) -> str:
    """The path of a file's URI; other file systems are refused."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{uri} is no local path")
    return unquote(parsed.path)


def _literal(value: object) -> str:
    """A key's value in SQL."""
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def read_parts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """All Parquet files below root that match, with source_part: the folder each came from."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(root)
    return rows.withColumn("source_part", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists, by Spark's file systems."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def listing(spark: SparkSession, root: str, suffixes: Sequence[str], limit: int | None = None) -> DataFrame:
    """path, length and time of the files below root with one of the suffixes; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    files = files.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")).orderBy("path")
    return files.limit(limit) if limit else files


def archive_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """member and text lines of tar (.gz) and zip archives, an archive for each task."""
    import re
    from collections.abc import Iterator

    import pandas as pd

    wanted = re.compile(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import tarfile
        import zipfile

        for batch in batches:
            for data in batch["content"]:
                held = io.BytesIO(data)
                if zipfile.is_zipfile(held):
                    with zipfile.ZipFile(held) as z:
                        members = [(n, z.read(n)) for n in z.namelist() if wanted.search(n)]
                else:
                    held.seek(0)
                    with tarfile.open(fileobj=held) as t:
                        members = [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile() and wanted.search(m.name)]
                for name, body in members:
                    lines = body.decode("utf-8", "replace").splitlines()
                    yield pd.DataFrame({"member": name, "line_no": range(len(lines)), "line": lines})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "member string, line_no long, line string")


def read_npy(spark: SparkSession, path: str, rows: int = 8192) -> DataFrame:
    """row_no and values (array of double) of the matrices in .npy files, a file for each task and ``rows`` rows at a time."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for batch in batches:
            for data in batch["content"]:
                matrix = np.load(io.BytesIO(data), allow_pickle=False)
                for i in range(0, len(matrix), rows):
                    part = matrix[i : i + rows].astype(float)
                    yield pd.DataFrame({"row_no": range(i, i + len(part)), "values": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row_no long, values array<double>")


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file on any of Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def pipe_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, table_no, row_no, cells of the Markdown pipe tables in a text column: header row 0, ragged rows and the rule left out."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    piped = F.col("line").startswith("|") & F.col("line").endswith("|")
    order = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("table_no", F.sum((~piped).cast("int")).over(order)).where(piped)
    lines = lines.where(~F.col("line").rlike(r"^\|[\s:|-]+\|$"))
    cells = F.transform(F.split(F.expr("substring(line, 2, length(line) - 2)"), r"\|"), lambda x: F.trim(x))
    lines = lines.withColumn("cells", cells).withColumn("row_no", F.row_number().over(Window.partitionBy(key, "table_no").orderBy("line_no")) - 1)
    head = F.first("cells").over(Window.partitionBy(key, "table_no").orderBy("line_no"))
    lines = lines.withColumn("width", F.size(head)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key, "table_no")))
    return lines.where((F.size("cells") == F.col("width")) & (F.col("n") >= 2)).select(key, "table_no", "row_no", "cells")


def csv_after_heading(df: DataFrame, key: str, text: str, heading: str) -> DataFrame:
    """key, row_no, cells of the comma-separated lines that follow a heading, up to the next heading."""
    body = F.regexp_extract(text, r"(?ms)^#+[ \t]*" + heading + r"[ \t]*$(.*?)(?=^#|\z)", 1)
    lines = df.select(key, F.posexplode(F.filter(F.split(body, "\n"), lambda x: x.contains(","))).alias("row_no", "line"))
    return lines.select(key, "row_no", F.transform(F.split("line", ","), lambda x: F.trim(x)).alias("cells"))
