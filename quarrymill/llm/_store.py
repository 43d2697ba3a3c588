"""Folders that driver and executors share, and reads of written stages."""

from __future__ import annotations

import contextlib
import itertools
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def top_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir, else one in the warehouse; a warehouse on the machines' own disks is refused on a cluster."""
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not local and warehouse.startswith(("file:", "/")):
        raise ValueError("spark.checkpoint.dir is unset and the warehouse is a folder of each machine: name a folder that driver and executors share")
    return f"{warehouse}/_shared"


def shared_folder(spark: SparkSession) -> str:
    """A new folder's URI in the shared folder."""
    uri = f"{top_folder(spark)}/quarrymill-{uuid.uuid4().hex}"
    if _held:
        _held[-1].append(uri)
    return uri


_held: list[list[str]] = []
#: Tables written between two collections of the driver's garbage.
COLLECTED = 8
_count = itertools.count(1)


@contextlib.contextmanager
def scratch(spark: SparkSession, kept: list[str] | None = None) -> Iterator[None]:
    """Deletes the folders made inside when it ends, but for those in ``kept``. Only for results that are written by then."""
    _held.append([])
    try:
        yield
    finally:
        for uri in _held.pop():
            if uri not in (kept or ()):
                removed(spark, uri)
            elif _held:
                _held[-1].append(uri)


def written(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again, which cuts its lineage."""
    return written_at(df)[0]


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``written``, and the folder's URI."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    if next(_count) % COLLECTED == 0:
        collected(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def collected(spark: SparkSession) -> None:
    """Collect the driver's garbage. Every stage, broadcast and relation leaves buffers of some MB there, for which the heap grows before it is collected, and
    Spark keeps a shuffle's files and a broadcast's blocks until the driver has dropped its plan."""
    spark._jvm.System.gc()


def removed(spark: SparkSession, uri: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with more underscores before those that a column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
