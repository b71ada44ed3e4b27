"""Table functions for SQL: chunks of texts, and the best rows of a group."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

CHUNK_SIZE, CHUNK_OVERLAP = 512, 64


@udtf(returnType="doc_id bigint, chunk_index bigint, text string")
class TextChunks:
    """``text_chunks(TABLE(SELECT doc_id, text ...), size, overlap)``: windows of words as ``chunk_texts`` makes them.

    Rows are independent, so the table may be partitioned by anything or not at all.
    """

    def eval(self, row, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple]:
        if not 0 <= overlap < size:
            raise ValueError("the overlap must be smaller than the window")
        words = re.findall(r"\S+", row["text"] or "", re.ASCII)
        for i, start in enumerate(range(0, len(words), size - overlap)):
            yield row["doc_id"], i, " ".join(words[start : start + size])


@udtf(returnType="query_id bigint, rank int, id bigint, score double")
class BestRows:
    """``best_rows(TABLE(SELECT query_id, id, score ...) PARTITION BY query_id ORDER BY (score DESC, id), k)``: the first ``k`` of each query."""

    def __init__(self):
        self.rank = 0

    def eval(self, row, k: int) -> Iterator[tuple]:
        if self.rank < k:
            self.rank += 1
            yield row["query_id"], self.rank, row["id"], row["score"]


def register_table_functions(spark: SparkSession) -> None:
    """``text_chunks`` and ``best_rows`` for the session's SQL."""
    spark.udtf.register("text_chunks", TextChunks)
    spark.udtf.register("best_rows", BestRows)
