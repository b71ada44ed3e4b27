"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_groups, materialise, own_names

#: Binomial rounds are taken three at a time: up to 2**3 runs meet in one merge.
ROUND_BITS = 3
#: Each digest range has a tree of its own, so no root holds more than a range.
RANGES_PER_TASK = 16

_RUN = "bucket int, node int, digest string, proof long, n_points long, best_id long, best_row long, n_rows long"


def _order() -> list[Column | str]:
    best = [F.col("n_points").desc(), F.col("best_id").asc_nulls_last(), F.col("best_row")]
    return ["bucket", "node", "digest", "proof", *best]


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Collapse equal digests in rows sorted by ``_order``: the first row stays, counts add up.

    The last group of a batch is held back, as it may go on in the next one.
    """
    held: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if rows.empty:
            continue
        new = np.zeros(len(rows), dtype=bool)
        new[0] = True
        for c in ("bucket", "node", "digest", "proof"):
            v = rows[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        at = np.flatnonzero(new)
        sums = np.add.reduceat(rows["n_rows"].to_numpy(), at)
        rows = rows.iloc[at].assign(n_rows=sums)
        held = rows.iloc[-1:]
        if len(rows) > 1:
            yield rows.iloc[:-1]
    if held is not None:
        yield held


def text_digests(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, row_id, text_sha256, proof and n_points.

    ``proof`` is a second, independent hash of the normalised text: rows count as
    equal only if both agree.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.regexp_replace(text, SPACE + "+", "")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row_id"),
        F.sha2(plain.cast("binary"), 256).alias("text_sha256"),
        F.xxhash64(plain, F.length(plain)).alias("proof"),
        F.length(text).cast("long").alias("n_points"),
    )


def merge_runs(digests: DataFrame) -> DataFrame:
    """One row a distinct text: digest, proof, best_id, best_row and n_rows.

    Each partition sorts its digests into a run.  In every round the runs of
    nodes ``8i .. 8i+7`` meet at node ``i``; the shuffle sort merges them and
    ``_merge`` keeps the best verified identifier of each digest, so a group of
    copies takes one row from each node, however large it is.
    """
    spark = digests.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    nodes = max(digests.rdd.getNumPartitions(), 1)
    ranges = RANGES_PER_TASK * tasks
    runs = digests.select(
        F.expr(f"cast(conv(substr(text_sha256, 1, 8), 16, 10) as long) * {ranges} div 4294967296").cast("int").alias("bucket"),
        F.spark_partition_id().alias("node"),
        F.col("text_sha256").alias("digest"),
        "proof",
        "n_points",
        F.col("doc_id").alias("best_id"),
        F.col("row_id").alias("best_row"),
        F.lit(1).cast("long").alias("n_rows"),
    )
    runs = runs.sortWithinPartitions(*_order()).mapInPandas(_merge, _RUN)
    while True:
        nodes = -(-nodes // 2**ROUND_BITS)
        runs = (
            runs.withColumn("node", F.shiftright("node", ROUND_BITS))
            .repartition(tasks, "bucket", "node")
            .sortWithinPartitions(*_order())
            .mapInPandas(_merge, _RUN)
        )
        if nodes == 1:
            return runs.select("digest", "proof", "best_id", "best_row", "n_rows")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of ``docs``.

    Texts are equal when they are identical without the characters of
    ``[\\x20\\x09-\\x0D]``; a null text counts as empty, and empty texts are equal.
    Of equal texts the row with the most code points stays, then the smallest
    doc_id (null counts as largest), then any one of the repeated rows.  Further
    columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    digests = materialise(text_digests(docs), "digests")
    groups = materialise(
        merge_runs(digests)
        .where("n_rows > 1")
        .select(F.col("digest").alias("text_sha256"), "proof", "best_id", "best_row", "n_rows"),
        "groups",
    )
    joined = join_groups(digests, groups, ["text_sha256", "proof"], "n_rows")
    alone = F.col("n_rows").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("n_rows", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_id") == F.col("best_row"))).alias("kept"),
        "text_sha256",
    )


@own_names
def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    A dropped row is told by doc_id and digest; rows that repeat both are one row.
    """
    groups = materialise(exact_groups(docs), "exact")
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")
    )
    plain = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE + "+", "")
    marked = docs.withColumn("__sha256", F.sha2(plain.cast("binary"), 256))
    left = marked.join(gone.distinct(), (F.col("doc_id").eqNullSafe(F.col("__id"))) & (F.col("__sha256") == F.col("__sha")), "left_anti")
    repeated = groups.where("doc_id <=> keep_id and not kept").limit(1).count()
    if repeated:
        left = left.dropDuplicates(["doc_id", "__sha256"])
    return left.select(*docs.columns)
