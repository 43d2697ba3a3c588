"""Text search over an inverted index that is a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Rounds, folder, kept

#: The usual English stop words.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def analyze(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case runs of a-z and digits without stop words, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: (x != "") & ~x.isin(list(stop)))


def index(docs: DataFrame, key: str, fields: Mapping[str, float], stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """field, key, term, tf, len: the postings of all fields. Texts are dealt by their key, and postings are counted where they stand."""
    held = docs.select(key, *(F.coalesce(f, F.lit("")).alias(f"_{f}") for f in fields)).repartition(key)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), analyze(F.col(f"_{f}"), stop).alias("t")) for f in fields))).alias("_f")
    rows = held.select(key, each).select(key, F.col("_f.field").alias("field"), F.size("_f.t").alias("len"), F.explode("_f.t").alias("term"))
    return rows.groupBy("field", key, "len", "term").agg(F.count("*").alias("tf"))


def _equals(term: str):
    return lambda x: x == term


def search(docs: DataFrame, key: str, fields: Mapping[str, float], query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score: BM25 of the best field times its boost, for documents of which one field holds all terms.

    The terms are known before the scan, so only their counts leave it; there is no index to build for a single query.
    """
    import re

    terms = [t for t in dict.fromkeys(re.findall("[a-z0-9]+", query.lower())) if t not in STOP_WORDS]
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    out = None
    for field, boost in fields.items():
        words = analyze(F.coalesce(field, F.lit("")))
        rows = docs.select(key, words.alias("_t")).select(key, F.size("_t").alias("len"), *(F.size(F.filter("_t", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)))
        stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
        hit = reduce(lambda x, y: x & y, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
        parts = [F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))) for i in range(len(terms))]
        found = rows.where(hit).crossJoin(F.broadcast(stats)).select(key, (F.lit(boost) * reduce(lambda x, y: x + y, parts)).alias("score"))  # stats is one row
        out = found if out is None else out.unionByName(found)
    return out.groupBy(key).agg(F.max("score").alias("score"))


#: Postings of a block on average, blocks of a query that give its first bound, and decimals by which scores are ranked.
BLOCK = 128
FIRST_BLOCKS = 8
DECIMALS = 6
_UNIT = 1 << 52


@dataclass(frozen=True)
class Index:
    """An inverted index in a folder: blocks of postings and the dictionary of terms, both in folders by bucket of the term."""

    path: str
    key: str
    fields: Mapping[str, float]
    buckets: int
    k1: float
    b: float

    def blocks(self, spark: SparkSession) -> DataFrame:
        """field, term, block, bound (the largest weight of its postings), docs (key, weight), bucket."""
        return spark.read.parquet(f"{self.path}/blocks")

    def terms(self, spark: SparkSession) -> DataFrame:
        """field, term, df, n_blocks, idf, bound (of all blocks), bucket."""
        return spark.read.parquet(f"{self.path}/terms")


def _bucket(term: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _block(key: str | Column, blocks: str | Column) -> Column:
    """Block of a key in a term of so many blocks. Blocks are ranges of the key's hash, so the key alone tells its block in every term."""
    return F.floor(F.pmod(F.xxhash64(key), F.lit(_UNIT)) / float(_UNIT) * F.col(blocks)).cast("long")


def build(docs: DataFrame, key: str, fields: Mapping[str, float], path: str | None = None, buckets: int = 64, k1: float = 1.2, b: float = 0.75, files: int | None = None) -> Index:
    """Write the index of the documents' fields (with their boosts) below path, by default in the shared folder.

    A term's postings are cut into blocks of about ``BLOCK`` by ranges of the key's hash, so no task holds a frequent term. Each
    posting has its BM25 weight but for the term's rarity, and each block the largest of these. Files are sorted by term, so
    a read of some terms opens their buckets and, within them, few row groups.
    """
    spark = docs.sparkSession
    path = path or folder(spark)
    tables = Rounds(spark)
    rows = tables.saved("rows", index(docs, key, fields).withColumnRenamed(key, "key"))
    sizes = docs.agg(F.count("*").alias("n"), *(F.avg(F.size(analyze(F.coalesce(f, F.lit(""))))).alias(f) for f in fields)).first()
    mean = F.element_at(F.create_map(*(x for f in fields for x in (F.lit(f), F.lit(float(sizes[f] or 0) or 1.0)))), F.col("field"))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    idf = F.log(1 + (F.lit(sizes.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = rows.withColumn("w", weight).groupBy("field", "term").agg(F.count("*").alias("df"), F.max("w").alias("bound"))
    terms = terms.select("*", F.ceil(F.col("df") / BLOCK).alias("n_blocks"), idf.alias("idf"), _bucket("term", buckets).alias("bucket"))
    parts = files or max(1, rows.rdd.getNumPartitions())
    terms.repartitionByRange(parts, "bucket", "term").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    counted = rows.join(spark.read.parquet(f"{path}/terms").select("field", "term", "n_blocks"), ["field", "term"])
    # postings are dealt by ranges of what the files are sorted by, and are grouped where they stand then
    dealt = counted.select("field", "term", "key", _block("key", "n_blocks").alias("block"), weight.alias("weight"), _bucket("term", buckets).alias("bucket")).repartitionByRange(parts, "bucket", "term", "block")
    blocks = dealt.groupBy("field", "bucket", "term", "block").agg(F.max("weight").alias("bound"), F.sort_array(F.collect_list(F.struct("key", "weight"))).alias("docs"))
    blocks.select("field", "term", "block", "bound", "docs", "bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/blocks")
    tables.dropped()
    return Index(path, key, dict(fields), buckets, k1, b)


def _sought(index: Index, queries: DataFrame, id_: str, text: str) -> DataFrame:
    """query, field, term, boosted idf, n_blocks, bound, bucket, lead (1 for the query's rarest term): queries of which a field knows all terms."""
    spark = queries.sparkSession
    words = F.array_distinct(analyze(F.col(text)))
    terms = queries.select(F.col(id_).alias("query"), F.size(words).alias("n"), F.explode(words).alias("term")).withColumn("bucket", _bucket("term", index.buckets))
    known = index.terms(spark).where(F.col("bucket").isin(_buckets(terms))).select("field", "term", "df", "n_blocks", "idf", "bound", "bucket")
    boost = F.element_at(F.create_map(*(F.lit(v) for kv in index.fields.items() for v in (kv[0], float(kv[1])))), F.col("field"))
    own = Window.partitionBy("query", "field")
    found = terms.join(known, ["term", "bucket"]).withColumn("_m", F.count("*").over(own)).withColumn("lead", F.row_number().over(own.orderBy("df", "term"))).where("_m = n")
    return found.select("query", "field", "term", (F.col("idf") * boost).alias("idf"), "n_blocks", "bound", "bucket", "lead")


def _buckets(terms: DataFrame) -> list[int]:
    """The buckets of some terms, of which there are as many as the index has."""
    return [r.bucket for r in terms.select("bucket").distinct().collect()]


def top(index: Index, queries: DataFrame, id_: str, text: str, k: int, among: DataFrame | None = None) -> DataFrame:
    """id, key, score, rank: the k best documents of each query, by BM25 of the best field times its boost, of which one field holds all terms.

    Scores equal those of ``search``; equal scores (to ``DECIMALS``) go by key. ``among`` has the keys to which a search is restricted.

    Results stand in the blocks of a query's rarest term. The most promising ``FIRST_BLOCKS`` of these, by their bounds, are scored, and
    the k-th score found there bounds the rest from below: other blocks whose bound is lower are not read, and of those that are, a
    document is looked up in the other terms' blocks only if the bounds of these blocks let it reach that score. No bound is too low, so
    nothing is lost.
    """
    spark = queries.sparkSession
    sought = kept(_sought(index, queries, id_, text))
    stored = index.blocks(spark).where(F.col("bucket").isin(_buckets(sought)))
    lead, others = sought.where("lead = 1"), sought.where("lead > 1").select("query", "field", "term", "bucket", F.col("idf").alias("_idf"), F.col("n_blocks").alias("_n"), F.col("bound").alias("_top"))
    rest = others.groupBy("query", "field").agg(F.sum(F.col("_idf") * F.col("_top")).alias("_rest"))
    known = stored.select("field", "term", "bucket", "block", F.col("bound").alias("_bound"))
    promised = lead.join(known, ["field", "term", "bucket"]).join(rest, ["query", "field"], "left")
    promised = promised.select("query", "field", "term", "bucket", "block", "idf", (F.col("idf") * F.col("_bound") + F.coalesce("_rest", F.lit(0.0))).alias("most"))
    promised = kept(promised.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("most"), "field", "block"))))

    def scored(blocks: DataFrame, floor: DataFrame | None) -> DataFrame:
        opened = blocks.join(stored.select("field", "term", "bucket", "block", "docs"), ["field", "term", "bucket", "block"]).select("query", "field", "idf", F.inline("docs"))
        if among is not None:
            opened = opened.join(among.select(F.col(index.key).alias("key")).distinct(), "key", "left_semi")
        opened = opened.select("query", "field", "key", (F.col("idf") * F.col("weight")).alias("_s"))
        more = opened.join(others, ["query", "field"]).withColumn("block", _block("key", "_n"))
        alone = opened.join(others, ["query", "field"], "left_anti").select("query", "key", F.col("_s").alias("score"))
        if floor is not None:
            hopes = more.join(known, ["field", "term", "bucket", "block"]).groupBy("query", "field", "key").agg((F.first("_s") + F.sum(F.col("_idf") * F.col("_bound"))).alias("_most"), F.count("*").alias("_m"))
            more = more.join(hopes.join(floor, "query", "left").where(_may("_most")).select("query", "field", "key"), ["query", "field", "key"], "left_semi")
        wanted = more.groupBy("field", "term", "bucket", "block", "key").agg(F.collect_list(F.struct("query", "_s", "_idf")).alias("_q"))
        hit = wanted.join(stored.select("field", "term", "bucket", "block", "docs"), ["field", "term", "bucket", "block"])
        place = F.array_position(F.transform("docs", lambda x: x["key"]), F.col("key"))
        hit = hit.withColumn("_at", place).where("_at > 0").select("field", "key", F.get("docs", (F.col("_at") - 1).cast("int"))["weight"].alias("_w"), F.explode("_q").alias("_q"))
        sums = hit.select("_q.query", "field", "key", "_q._s", (F.col("_q._idf") * F.col("_w")).alias("_p")).groupBy("query", "field", "key").agg((F.first("_s") + F.sum("_p")).alias("score"), F.count("*").alias("_m"))
        terms = others.groupBy("query", "field").agg(F.count("*").alias("_m"))
        return alone.unionByName(sums.join(terms, ["query", "field", "_m"]).select("query", "key", "score"))

    best = lambda df: df.groupBy("query", "key").agg(F.round(F.max("score"), DECIMALS).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    first = kept(scored(promised.where(F.col("_r") <= FIRST_BLOCKS), None))
    floor = best(first).withColumn("_n", rank).where(F.col("_n") == k).select("query", F.col("score").alias("_floor"))
    left = promised.where(F.col("_r") > FIRST_BLOCKS).join(floor, "query", "left").where(_may("most")).drop("_floor")
    out = best(first.unionByName(scored(left, floor))).withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select(F.col("query").alias(id_), F.col("key").alias(index.key), "score", "rank")


def _may(most: str) -> Column:
    """Whether a bound lets a score reach the floor, where there is one; with room for rounding."""
    return F.col("_floor").isNull() | (F.col(most) * (1 + 1e-9) + 10.0**-DECIMALS >= F.col("_floor"))


def snippet(text: Column, term: str, around: int = 40) -> Column:
    """The text around the first occurrence of a term, else its beginning."""
    at = F.locate(term.lower(), F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(term)))).otherwise(F.substring(text, 1, 2 * around))


def collapse(hits: DataFrame, keys: Sequence[str], score: str, source: str) -> DataFrame:
    """A row for each key with the best score, its source, and all sources in order."""
    return hits.groupBy(*keys).agg(F.max(score).alias("score"), F.max_by(source, F.struct(score, source)).alias("best_source"), F.array_join(F.array_sort(F.collect_set(source)), "|").alias("sources"), F.count("*").alias("hits"))
