"""Databases that the tasks open themselves, on several executors."""

from __future__ import annotations

import os
import subprocess
import sys

from quarrymill.sources import tables as T

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

_RUN = """
import sys
from pyspark.sql import SparkSession, functions as F
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1024m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{sys.argv[1]}/shared", "spark.sql.warehouse.dir": f"{sys.argv[1]}/warehouse"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__ as e
d = "/root/testdata/sf0.001"
got = e.queries()["src12_jdbc"](spark, d)
want = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.expr("n_nationkey = c_nationkey")).select("c_custkey", "c_name", "n_name")
for _ in range(2):  # a task that runs again loads its range anew
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
print("SAME ROWS")
"""


def test_join_on_several_executors(tmp_path):
    import pyspark

    home = tmp_path / "home"  # executors' logs go to work in Spark's home
    home.mkdir()
    for name in os.listdir(source := os.path.dirname(pyspark.__file__)):
        if name != "work":
            (home / name).symlink_to(os.path.join(source, name))
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYSPARK_PYTHON": sys.executable}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS")}
    said = subprocess.run([sys.executable, "-c", _RUN, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "SAME ROWS" in said.stdout, said.stderr[-3000:]


def test_odd_values_reach_the_databases(spark):
    rows = [(1, 'a "b", \\ c', 1), (2, "", 1), (3, None, 2), (4, "ü\nnext", None), (None, "no key", 2), (6, " x ", 3)]
    left = spark.createDataFrame(rows, "k long, s string, n int")
    right = spark.createDataFrame([(1, "one"), (2, ""), (3, None)], "m int, t string")
    query = 'SELECT a."k", a."s", b."t" FROM odd a LEFT JOIN beside b ON b."m" = a."n"'
    names = {1: "one", 2: "", 3: None}
    got = T.read_derby_shards(spark, left, "odd", {"beside": right}, query, "k").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((k, s, names.get(n))) for k, s, n in rows)


def test_no_rows(spark):
    left, right = spark.createDataFrame([], "k long, n int"), spark.createDataFrame([(1, "one")], "m int, t string")
    assert T.read_derby_shards(spark, left, "odd", {"beside": right}, 'SELECT a."k", b."t" FROM odd a JOIN beside b ON b."m" = a."n"', "k").collect() == []
