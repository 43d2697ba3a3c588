"""The folder that driver and executors share, and tables that are kept there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def top(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or one in the warehouse; a warehouse on the machines' own disks is refused on a cluster."""
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not local and warehouse.startswith(("file:", "/")):
        raise ValueError("spark.checkpoint.dir is unset and the warehouse is a folder of each machine: name a folder that driver and executors share")
    return f"{warehouse}/_shared"


def folder(spark: SparkSession) -> str:
    """A new folder's URI there."""
    return f"{top(spark)}/quarrymill-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df with its rows fixed and its lineage cut, by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(top(df.sparkSession))
    return df.checkpoint()


class Rounds:
    """Tables that a loop writes to the shared folder and reads again. A plan over them is as short in the last round as in the first."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def saved(self, name: str, df: DataFrame) -> DataFrame:
        """df as a table; the table of an earlier round under the same name goes."""
        path = folder(self.spark)
        df.write.parquet(path)
        self.dropped(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def dropped(self, *names: str) -> None:
        """Delete the tables of these names, by default all."""
        for name in names or list(self.paths):
            if name in self.paths:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
