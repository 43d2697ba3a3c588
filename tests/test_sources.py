"""Readers whose inputs no table holds: archives, and databases."""

from __future__ import annotations

import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from quarrymill.sources import sinks
from quarrymill.sources import tables as T


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, body in (("x.tsv", b"a\tb\n1\t2\n"), ("skip.txt", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("y.tsv", "c\td\n")
    rows = T.archive_members(spark, str(tmp_path), r"\.tsv$").orderBy("member", "line_no").collect()
    assert [(r.member, r.line) for r in rows] == [("x.tsv", "a\tb"), ("x.tsv", "1\t2"), ("y.tsv", "c\td")]


def test_fixed_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    sinks.write_csv(df, str(tmp_path / "t.csv"), ["a", "missing", "b"])
    back = T.read_any(spark, str(tmp_path / "t.csv"))
    assert back.columns == ["a", "missing", "b"] and tuple(back.first()) == ("x", None, "1")


def test_merge_lists_and_upsert(spark):
    from quarrymill.operators.relational import merge_lists

    df = spark.createDataFrame([("k", 1, "b|a", "first"), ("k", 2, "a|c", "second"), ("m", 1, None, None)], "k string, o int, l string, f string")
    got = {r.k: (r.f, r.l) for r in merge_lists(df, "k", "o", ["l"], ["f"]).collect()}
    assert got == {"k": ("first", "b|a|c"), "m": (None, None)}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, sinks.replace_where(old, F.col("k") == 1, new.where("k = 3")).collect())) == [(2, "b"), (3, "d")]
