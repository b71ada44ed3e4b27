"""An inverted index of texts: written postings, merged by segments, and BM25 top-k over the postings of asked terms.

An index is two tables.  ``lengths`` has a row a text with its number of terms.
``postings`` has a row a block: a term, at most about ``BLOCK`` texts that hold it with
their counts and lengths, and what bounds the block's scores (the largest count and the
shortest text).  Blocks lie in folders by a hash of their term, sorted by term, so a
search reads the folders and row groups of the terms that it asks for and no text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..storage import materialise, shared_folder
from .search import terms

#: A reader unpacks thousands of blocks at a time, so these are short.
BUCKETS, BLOCK = 32, 256
K1, B = 1.2, 0.75
#: Texts and about how many of their postings a task scores at a time, and queries for which it does.
SHARD, ENTRIES, QUERIES = 16_384, 1 << 20, 20_000

_POSTINGS = "bucket int, term string, n int, most int, shortest int, ids array<long>, counts array<int>, sizes array<int>"
_LENGTHS = "id long, n_terms int"


@dataclass(frozen=True)
class TextIndex:
    """The folder of a written index; its tables are read when asked for."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings")

    @property
    def lengths(self) -> DataFrame:
        return self.spark.read.schema(_LENGTHS).parquet(f"{self.path}/lengths")

    def is_there(self) -> bool:
        """Whether both tables can still be read."""
        try:
            return len(self.postings.columns) > 0 and len(self.lengths.columns) > 0
        except AnalysisException:
            return False


def _entries(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """id and n_terms of each text, and term, id, size and count of each term in it, written once."""
    held = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    # The terms of a text are counted in its row, so nothing is shuffled: equal ones lie together once they are sorted.
    words = held.where(F.size("terms") > 0).select("id", F.size("terms").alias("size"), F.sort_array("terms").alias("terms"))
    starts = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))
    runs = words.select("id", "size", "terms", F.concat(starts, F.array("size")).alias("starts"))
    run = F.transform(F.slice("starts", 1, F.size("starts") - 1), lambda x, i: F.struct(F.get("terms", x).alias("term"), (F.get("starts", i + 1) - x).alias("count")))
    each = runs.select("id", "size", F.explode(run).alias("e"))
    counted = materialise(each.select(F.col("e.term").alias("term"), "id", "size", F.col("e.count").alias("count")), "entries")
    # Texts are split into terms once: their lengths come from the entries, 0 where there are none.
    sizes = counted.groupBy("id").agg(F.max("size").alias("n_terms"))
    lengths = held.select("id").join(sizes, "id", "left").select("id", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    return lengths, counted


def _write(spark: SparkSession, lengths: DataFrame, entries: DataFrame, buckets: int, block: int) -> TextIndex:
    """Pack entries into blocks and write both tables.

    The texts of a frequent term are dealt over its blocks by a hash of the id, so no group
    is longer than about a block, whatever share of the texts holds the term.
    """
    path = f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}"
    frequent = entries.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > block)
    dealt = entries.join(frequent, "term", "left").withColumn("part", F.when(F.col("df").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / block))))
    packed = dealt.groupBy("term", "part").agg(F.sort_array(F.collect_list(F.struct("id", "count", "size"))).alias("e"))
    rows = packed.select(
        F.pmod(F.hash("term"), F.lit(buckets)).alias("bucket"), "term", F.size("e").alias("n"), F.array_max("e.count").alias("most"), F.array_min("e.size").alias("shortest"),
        F.col("e.id").alias("ids"), F.col("e.count").alias("counts"), F.col("e.size").alias("sizes"),
    )
    rows.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    lengths.write.parquet(f"{path}/lengths")
    return TextIndex(spark, path, buckets)


def build_text_index(docs: DataFrame, id_col: str = "id", text_col: str = "text", buckets: int = BUCKETS, block: int = BLOCK) -> TextIndex:
    """The index of all texts.  A null text has no terms; rows without id are left out; ids are integers, one a row."""
    lengths, entries = _entries(docs, id_col, text_col)
    return _write(docs.sparkSession, lengths, entries, buckets, block)


def _unpacked(postings: DataFrame) -> DataFrame:
    e = F.explode(F.arrays_zip("ids", "counts", "sizes")).alias("e")
    return postings.select("term", e).select("term", F.col("e.ids").alias("id"), F.col("e.counts").alias("count"), F.col("e.sizes").alias("size"))


def merge_text_index(index: TextIndex, docs: DataFrame, id_col: str = "id", text_col: str = "text", block: int = BLOCK, gone: DataFrame | None = None) -> TextIndex:
    """The index after ``docs`` came in: texts with a known id replace what it had, all others are added.

    Only the new texts are read; the rest comes from the postings.  ``gone(id)`` leaves out more texts.
    """
    lengths, entries = _entries(docs, id_col, text_col)
    lengths = materialise(lengths, "lengths")
    out = lengths.select("id") if gone is None else lengths.select("id").unionByName(gone.select(F.col("id").cast("long").alias("id")))
    kept = index.lengths.join(out, "id", "left_anti")
    held = materialise(_unpacked(index.postings).join(out, "id", "left_anti"), "held")
    return _write(index.spark, kept.unionByName(lengths), held.unionByName(entries.select(*held.columns)), index.buckets, block)


def _weight(count: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    return count * (K1 + 1) / (count + K1 * (1 - B + B * size / mean))


def _best_of_shard(k: int, mean: float):
    """The ``k`` best texts that a shard has for each query of a block, from its postings of the block's terms."""

    def run(postings: pa.Table, asked: pa.Table) -> pa.Table:
        term = postings.column("number").to_numpy()
        order = np.argsort(term, kind="stable")
        term = term[order]
        ids, doc = np.unique(postings.column("id").to_numpy()[order], return_inverse=True)
        weight = _weight(*(postings.column(c).to_numpy()[order].astype(np.float64) for c in ("count", "size")), mean)
        found = []
        numbers, idf, queries = (asked.column(c).to_numpy() for c in ("number", "idf", "query_id"))
        # In one order in every shard, so that equal texts get equal sums.
        by_query = np.lexsort((numbers, queries))
        ends = np.flatnonzero(np.diff(queries[by_query])) + 1
        first, last = np.searchsorted(term, numbers, "left"), np.searchsorted(term, numbers, "right")
        for own in np.split(by_query, ends):
            scores = np.zeros(len(ids))
            for i in own:
                at = slice(first[i], last[i])
                np.add.at(scores, doc[at], idf[i] * weight[at])
            at = np.flatnonzero(scores)
            best = np.round(scores[at], 9)
            if len(at) > k:
                high = best >= np.partition(best, -k)[-k]
                at, best = at[high], best[high]
            # Ids are sorted, so of equal scores the smaller ones stay.
            top = np.argsort(-best, kind="stable")[:k]
            found.append((np.full(len(top), queries[own[0]]), ids[at[top]], best[top]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(columns, names=["query_id", "id", "score"])

    return run


def text_search_all(index: TextIndex, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score and rank (from 0) of the ``k`` best texts that hold any term of each ``queries(query_id, text)``.

    BM25 with the terms of a query counted once; equal scores go to the smaller id.  A query
    without terms, or of unknown terms only, has no result.

    Texts are dealt into shards of about ``SHARD`` texts or ``ENTRIES`` postings of asked
    terms, whichever is fewer, and queries into blocks of about ``QUERIES``.  A shard gets
    its postings of a block's terms once, whatever number of the queries asks for them, and
    only the ``k`` best that a task has for each query go on.
    """
    spark = index.spark
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(F.array_distinct(terms(F.coalesce("text", F.lit(""))))).alias("term"))
    asked = materialise(asked.withColumn("bucket", F.pmod(F.hash("term"), F.lit(index.buckets))), "asked")
    known = index.postings.join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
    counts = index.lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_terms").alias("mean")).first()
    mean, n_docs = counts["mean"] or 1.0, counts["n_docs"]
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    per_term = known.groupBy("bucket", "term").agg(F.sum("n").alias("df")).select("bucket", "term", "df", idf.alias("idf"))
    # Numbers stand for terms in what is sent to the shards.
    per_term = materialise(per_term.withColumn("number", F.monotonically_increasing_id()), "terms")
    n_entries = per_term.agg(F.sum("df")).first()[0] or 0

    shards, blocks = max(1, -(-n_docs // SHARD), -(-n_entries // ENTRIES)), max(1, -(-asked.select("query_id").distinct().count() // QUERIES))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    asked = materialise(asked.join(per_term, ["bucket", "term"]).select("query_id", "number", "idf", block), "asked")
    # Blocks of postings meet the terms before they are unpacked.
    wanted = per_term.join(asked.select("number", F.col("block").alias("for")).distinct(), "number").select("bucket", "term", "number", "for")
    e = F.explode(F.arrays_zip("ids", "counts", "sizes")).alias("e")
    entries = index.postings.join(wanted, ["bucket", "term"]).select("for", "number", e)
    held = F.pmod(F.xxhash64("e.ids"), F.lit(shards)).cast("int").alias("held")
    entries = entries.select("for", held, "number", F.col("e.ids").alias("id"), F.col("e.counts").alias("count"), F.col("e.sizes").alias("size"))
    everywhere = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    grouped = entries.groupBy("for", "held").cogroup(everywhere.groupBy("block", "shard"))
    parts = grouped.applyInArrow(_best_of_shard(k, mean), "query_id long, id long, score double")
    # A filter on the row number itself lets each task leave out rows before the shuffle.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def text_search_indexed(index: TextIndex, query: str, k: int, id_col: str = "id") -> DataFrame:
    """The ``k`` best texts for one query: ``id_col`` and score, best first."""
    asked = index.spark.createDataFrame([(0, query)], "query_id long, text string")
    return text_search_all(index, asked, k).orderBy("rank").select(F.col("id").alias(id_col), "score")
