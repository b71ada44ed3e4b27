"""Vector, text and hybrid search."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.similarity import cosine, store_score
from ..storage import materialise

RRF_K = 60
#: Queries that go to the tasks at a time, and rows that are scored against them at a time.
QUERY_BLOCK, ROW_BLOCK = 1000, 2000


def vector_search(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, id_col: str = "id") -> DataFrame:
    """The ``k`` rows nearest to ``query`` by cosine, with their index score.

    The filter is applied before any score.  Each task keeps its own best ``k``, so the
    driver's merge takes ``k`` rows from each and nothing is shuffled.
    """
    rows = vectors if where is None else vectors.where(where)
    point = F.lit([float(x) for x in query])
    scored = rows.withColumn("score", F.round(store_score(cosine(F.col("embedding"), point)), 9))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def _units(vectors: pa.Array) -> np.ndarray:
    """Rows of unit length, zero where a vector is null, empty or zero."""
    lists = vectors.to_pylist()
    width = max((len(v) for v in lists if v), default=0)
    rows = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        if v and len(v) == width:
            rows[i] = v
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _best_of_block(points: np.ndarray, names: list, k: int, id_col: str):
    """Arrow batches of id and vector to the ``k`` best rows that the task has for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, ids = np.zeros((0, len(names))), np.zeros((0, len(names)), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                rows = _units(part.column("embedding"))
                cosines = rows @ points.T if rows.shape[1] == points.shape[1] else np.zeros((len(rows), len(points)))
                own = np.repeat(part.column(id_col).to_numpy()[:, None], len(names), axis=1)
                scores, ids = np.vstack([scores, np.round((1 + cosines) / 2, 9)]), np.vstack([ids, own])
                order = np.lexsort((ids, -scores), axis=0)[:k]
                scores, ids = np.take_along_axis(scores, order, 0), np.take_along_axis(ids, order, 0)
        query = pa.array(np.tile(np.array(names, dtype=np.int64), len(ids)))
        yield pa.RecordBatch.from_arrays([query, pa.array(ids.ravel()), pa.array(scores.ravel())], ["query_id", id_col, "score"])

    return run


def vector_search_all(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, id_col: str = "id") -> DataFrame:
    """For each row of ``queries(query_id, embedding)`` its ``k`` nearest vectors, with their index scores.

    Queries go to the tasks in blocks of about ``QUERY_BLOCK``; a task multiplies its rows
    with a block and keeps its own best ``k`` of each query, so that a shuffle takes at
    most ``k`` rows a task and query, whatever the size of the table.  Exact; ids are
    integers and ties go to the smaller one.
    """
    rows = (vectors if where is None else vectors.where(where)).select(F.col(id_col).cast("long").alias(id_col), "embedding")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    parts = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        run = _best_of_block(_units(block.column("embedding").combine_chunks()), block.column("query_id").to_pylist(), k, id_col)
        parts.append(rows.mapInArrow(run, f"query_id long, `{id_col}` long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    ranked_rows = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best) - 1)
    return ranked_rows.where(F.col("rank") < k)


def terms(text: Column) -> Column:
    """Letters and digits in runs of two or more, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))


def node_text(columns: list[str]) -> Column:
    """What a node is searched by: its name, aliases, content and the aliases among its properties, as far as it has them."""
    fields = {"name": [F.col("name")], "aliases": [F.array_join("aliases", " ")], "properties": [F.element_at("properties", "content"), F.element_at("properties", "aliases")]}
    return F.concat_ws(" ", *[c for name, cs in fields.items() if name in columns for c in cs])


def text_search(docs: DataFrame, query: str, k: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The ``k`` best rows that hold any term of ``query``, by BM25 (k1 1.2, b 0.75).

    Only the terms of the query are counted in each row, so no index of all terms is
    built; document frequencies and the mean length are one aggregate.  A query without
    terms finds nothing.  ``text_index`` answers many queries without reading texts.
    """
    words = sorted({w for w in re.split(r"[\W_]+", query.lower()) if len(w) >= 2})
    if not words:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    held = docs.select(id_col, terms(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))

    def count(word: str) -> Column:
        return F.size("terms") - F.size(F.array_remove("terms", word))

    counts = [count(w).alias(f"n{i}") for i, w in enumerate(words)]
    # Written, a few numbers a row: texts are split into terms once.
    held = materialise(held.select(id_col, F.size("terms").alias("n_terms"), *counts), "term_counts")
    stats = held.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_terms").alias("mean"), *[F.count_if(F.col(f"n{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    # One row of corpus statistics.
    rows = held.where(F.greatest(*[F.col(f"n{i}") for i in range(len(words))], F.lit(0)) > 0).crossJoin(F.broadcast(stats))

    def part(i: int) -> Column:
        n, df = F.col(f"n{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
        return idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * F.col("n_terms") / F.col("mean")))

    score = sum((part(i) for i in range(1, len(words))), start=part(0))
    return rows.select(id_col, F.round(score, 9).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def rrf(lists: list[DataFrame], k: int = RRF_K, id_col: str = "id") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists, each with ``id_col`` and a 0-based ``rank``."""
    scored = None
    for i, ranked in enumerate(lists):
        part = ranked.select(id_col, (1.0 / (k + F.col("rank") + 1)).alias("part"), F.struct(F.lit(i).alias("list"), F.col("rank").cast("int").alias("rank")).alias("seen"))
        scored = part if scored is None else scored.unionByName(part)
    fused = scored.groupBy(id_col).agg(F.sum("part").alias("score"), F.min("seen").alias("seen"))
    return fused.withColumn("score", F.round("score", 12))


def ranked(found: DataFrame, id_col: str = "id") -> DataFrame:
    """A short result with 0-based ranks, best first."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)) - 1)


def hybrid_search(vector_hits: DataFrame | None, text_hits: DataFrame | None, top_k: int, k: int = RRF_K, id_col: str = "id") -> DataFrame:
    """Fused hits, best first; equal scores keep the order in which they were first seen.

    A leg that is None, or whose table lacks the index columns, leaves the other alone.
    """
    lists = []
    for hits in (vector_hits, text_hits):
        try:
            if hits is not None:
                lists.append(ranked(hits.select(id_col, "score"), id_col))
        except AnalysisException:
            continue
    if not lists:
        raise ValueError("neither leg can be searched")
    return rrf(lists, k, id_col).orderBy(F.desc("score"), "seen").limit(top_k).drop("seen")
