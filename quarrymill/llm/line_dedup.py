"""Operator 1: removal of repeated runs of lines, in DataFrame functions only.

``dedup_runs`` finds every repeated run of two lines or more, wherever it stands: two lines that follow each other, of
which one holds a word, are a pair, and a run is repeated where all its pairs are. Of equal pairs the first in the smallest
doc_id stays; of all others, whole runs of ``LEAST_WORDS`` words or more go, so headings, short lists and single short lines with a blank
one stay. A line goes only if an earlier copy of it is left, so no line is lost. Pairs are grouped by
the hashes of their lines; lines are grouped by their bytes, and two that share a hash stay as they are. A pair
that overlaps its first copy is no other copy.

``dedup`` is coarser, with fewer rows to group: a text's lines fall into chunks at content-defined borders: a chunk ends behind a line where a rolling hash over the
hashes of the last ``WINDOW`` lines has a given remainder, so a passage falls into the same chunks wherever it
stands, whatever is before it. Chunks of two lines or more that hold a word are counted over all documents, grouped by hash
and by their bytes, so chunks are equal only if their bytes are. Of equal chunks the first in the smallest doc_id
stays; all others go.

Grouping sums up on the map side, so a chunk that a third of all documents holds costs each task one row. The join that
takes the verdicts back to the documents has one narrow row for each chunk, and Spark splits a hot key there.

Rows of one doc_id count as one document: each keeps its first copy of a chunk that the doc_id owns. A null doc_id
comes last. Null text stays null and has no chunks; a text left without lines becomes empty. Other columns pass
through, whatever their names; those called n_lines, n_removed_lines and n_removed_chunks are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import fresh, written
from .quality import bound

#: Lines that the rolling hash spans; the mean number of lines of a chunk (a power of two).
WINDOW = 3
MEAN = 4
#: Words of a repeated run of lines that goes.
LEAST_WORDS = 10
_LAST = (1 << 63) - 1


def _turned(h: Column, n: int) -> Column:
    """A 64-bit rotation to the left."""
    return F.shiftleft(h, n).bitwiseOR(F.shiftrightunsigned(h, 64 - n)) if n else h


def chunks(text: Column) -> Column:
    """An array of structs for each text: n (lines), text."""

    def of_lines(lines: Column) -> Column:
        def of_hashes(h: Column) -> Column:
            def rolled(i: Column) -> Column:
                out = F.get(h, i)
                for back in range(1, WINDOW):
                    out = out.bitwiseXOR(F.coalesce(_turned(F.get(h, i - back), back), F.lit(0).cast("long")))
                return out

            last = F.size(h) - 1
            ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.xxhash64(rolled(i)).bitwiseAND(F.lit(MEAN - 1)) == 0))

            def cut(e: Column) -> Column:
                def one(end: Column, k: Column) -> Column:
                    start = F.coalesce(F.get(e, k - 1) + 1, F.lit(0))
                    return F.struct((end - start + 1).alias("n"), F.array_join(F.slice(lines, start + 1, end - start + 1), "\n").alias("text"))

                return F.transform(e, one)

            return bound(ends, cut)

        return bound(F.transform(lines, lambda x: F.xxhash64(x)), of_hashes)

    return bound(F.split(F.coalesce(text, F.lit("")), "\n"), of_lines)


def _keyed(docs: DataFrame) -> DataFrame:
    """Row keys and the chunks that may go, one row each: _doc, _row, pos, text."""
    rows = docs.where(F.col("text").contains("\n")).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_doc"), F.xxhash64("text").alias("_row"), F.posexplode(chunks(F.col("text"))).alias("pos", "_c"))
    rows = rows.where((F.col("_c.n") > 1) & F.col("_c.text").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select("_doc", "_row", "pos", F.col("_c.text").alias("text"), F.xxhash64("_c.text").alias("h"), F.xxhash64(F.lit(1), "_c.text").alias("g"))


def repeated(docs: DataFrame) -> DataFrame:
    """h, g, owner of every chunk that occurs twice or more. Bytes are compared by grouping on them; two texts with both hashes equal stay as they are."""
    texts = _keyed(docs).groupBy("h", "g", "text").agg(F.count("*").alias("n"), F.min("_doc").alias("owner"))
    return texts.groupBy("h", "g").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("owner").alias("owner")).where("n > 1 AND texts = 1").select("h", "g", "owner")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the text that stays, and n_lines, n_removed_lines, n_removed_chunks of each row."""
    places = _keyed(docs).groupBy("_doc", "_row", "h", "g").agg(F.array_distinct(F.sort_array(F.collect_list("pos"))).alias("at"))
    found = places.join(written(repeated(docs)), ["h", "g"])  # a table of its own, so Spark can split a hot key
    gone = F.when(F.col("_doc") == F.col("owner"), F.slice("at", F.lit(2), F.size("at"))).otherwise(F.col("at"))
    gone = found.select("_doc", "_row", gone.alias("at")).where(F.size("at") > 0).groupBy("_doc", "_row").agg(F.flatten(F.collect_list("at")).alias("_gone"))
    base = docs.drop("n_lines", "n_removed_lines", "n_removed_chunks")
    doc, row, lost, cut = fresh(base, "_doc", "_row", "_gone", "_c")
    keyed = base.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(row, F.xxhash64("text"))
    joined = keyed.join(gone.toDF(doc, row, lost), [doc, row], "left").withColumn(cut, F.when(F.col(lost).isNotNull(), chunks(F.col("text"))))
    kept = F.filter(cut, lambda c, k: ~F.array_contains(lost, k))
    lines = F.aggregate(F.filter(cut, lambda c, k: F.array_contains(lost, k)), F.lit(0), lambda t, c: t + c["n"])
    out = joined.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long"),
            "n_removed_lines": F.coalesce(lines, F.lit(0)).cast("long"),
            "n_removed_chunks": F.coalesce(F.size(lost), F.lit(0)).cast("long"),
            "text": F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda c: c["text"]), "\n")),
        }
    )
    return out.select(*base.columns, "n_lines", "n_removed_lines", "n_removed_chunks")


def _lined(docs: DataFrame) -> DataFrame:
    """Row keys and lines of the texts with two lines or more: _doc, _row, lines."""
    return docs.where(F.col("text").contains("\n")).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_doc"), F.xxhash64("text").alias("_row"), F.split("text", "\n").alias("lines"))


def _pairs(docs: DataFrame) -> DataFrame:
    """Pairs of lines that follow each other and hold a word, one row each: _doc, _row, pos, a, b (the lines' hashes)."""
    hashed = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), x.rlike(r"[^\x20\x09-\x0D]").alias("w")))

    def paired(x: Column) -> Column:
        both = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda p, q: F.struct(p["h"].alias("a"), q["h"].alias("b"), (p["w"] | q["w"]).alias("w")))
        return F.filter(F.transform(both, lambda p, i: F.struct(i.alias("pos"), p["a"].alias("a"), p["b"].alias("b"), p["w"].alias("w"))), lambda p: p["w"])

    return _lined(docs).select("_doc", "_row", F.explode(bound(hashed, paired)).alias("_p")).select("_doc", "_row", "_p.pos", "_p.a", "_p.b")


def _ambiguous(docs: DataFrame) -> DataFrame:
    """h of lines that differ in their bytes and share the hash; as good as always empty."""
    lines = _lined(docs).select(F.explode("lines").alias("line")).select(F.xxhash64("line").alias("h"), "line")
    return lines.groupBy("h", "line").agg(F.lit(1).alias("_one")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")


def _long_runs(lines: Column, gone: Column) -> Column:
    """first and last line of each run of lines that the pairs in ``gone`` (sorted) cover and that holds words enough."""
    first = F.filter(gone, lambda p, k: (k == 0) | (p - F.get(gone, k - 1) > 2))
    last = F.transform(F.filter(gone, lambda p, k: (k == F.size(gone) - 1) | (F.get(gone, k + 1) - p > 2)), lambda p: p + 1)
    runs = F.zip_with(first, last, lambda a, z: F.struct(a.cast("int").alias("a"), z.cast("int").alias("z")))
    words = F.transform(lines, lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")))
    total = lambda w, r: F.aggregate(F.slice(w, r["a"] + 1, r["z"] - r["a"] + 1), F.lit(0), lambda t, n: t + n)
    return bound(words, lambda w: F.filter(runs, lambda r: total(w, r) >= LEAST_WORDS))


def dedup_runs(docs: DataFrame) -> DataFrame:
    """docs with the text that stays, and n_lines, n_removed_lines, n_removed_chunks (runs that are gone) of each row."""
    pairs, odd = _pairs(docs), written(_ambiguous(docs))
    if not odd.isEmpty():
        for c in ("a", "b"):
            pairs = pairs.join(odd.withColumnRenamed("h", c), c, "left_anti")
    often = written(pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("_doc").alias("owner")).where("n > 1").select("a", "b", "owner"))
    found = pairs.join(often, ["a", "b"]).groupBy("_doc", "_row", "a", "b", "owner").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    gone = F.when(F.col("_doc") == F.col("owner"), F.filter("at", lambda p: p > F.get("at", F.lit(0)) + 1)).otherwise(F.col("at"))
    gone = found.select("_doc", "_row", gone.alias("at")).where(F.size("at") > 0).groupBy("_doc", "_row").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("_gone"))
    base = docs.drop("n_lines", "n_removed_lines", "n_removed_chunks")
    doc, row, lost, rest, run = fresh(base, "_doc", "_row", "_gone", "_left", "_runs")
    keyed = base.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(row, F.xxhash64("text"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    joined = keyed.join(gone.toDF(doc, row, lost), [doc, row], "left").withColumn("n_lines", n.cast("long"))
    joined = joined.withColumn(run, F.when(F.col(lost).isNotNull(), _long_runs(F.split("text", "\n"), F.col(lost))))
    left = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), F.flatten(F.transform(run, lambda r: F.sequence(r["a"], r["z"]))))
    joined = joined.withColumn(rest, F.when(F.size(run) > 0, left))
    text = bound(F.split("text", "\n"), lambda lines: F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumns(
        {
            "n_removed_lines": F.when(F.col(rest).isNull(), 0).otherwise(F.col("n_lines") - F.size(rest)).cast("long"),
            "n_removed_chunks": F.when(F.col(rest).isNull(), 0).otherwise(F.size(run)).cast("long"),
            "text": F.when(F.col(rest).isNull(), F.col("text")).otherwise(text),
        }
    )
    return out.select(*base.columns, "n_lines", "n_removed_lines", "n_removed_chunks")
