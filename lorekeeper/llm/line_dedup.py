"""Line deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, join_groups, let, materialise


#: Columns that a table must not have.
_ID, _TEXT_HASH, _DROPS, _KEPT = (f"__line_dedup_{c}" for c in ("id", "text_hash", "drops", "kept"))


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def common_line_drops(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """doc_id, ``text_hash`` and ``drops``, the positions (from 0) of the lines that such a text of the document loses."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # A generator of its own, so that the whole text is not hashed again for each line.
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.explode(F.array(F.xxhash64(text))).alias("text_hash"))
    lines = lines.select("doc_id", "text_hash", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    held = materialise(keys.select("doc_id", "text_hash", "pos", _hash(F.col("key")).alias("h")), "lines")
    # One row a document and key first, so repeated rows and lines of a document count once.
    common = (
        held.groupBy("h", "doc_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_lines"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )
    common = materialise(common, "common_lines")
    lost = join_groups(held, common, ["h"], "n_lines", "inner").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # Rows that agree in doc_id and text lose the same lines, whose positions array_except takes once.
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_list("pos").alias("drops"))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Every row of ``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    Texts are split at ``\\n``; a null or empty text is one empty line.  Keys of at
    least ``min_chars`` code points in at least ``min_docs`` documents lose their
    lines in all documents but the one with the largest doc_id, which keeps all of
    its own.  Other lines stay in their order.  A null doc_id counts as one
    document and as the smallest; rows that repeat a doc_id are one document.
    Columns of ``docs`` with the names of results are replaced.
    """
    drops = common_line_drops(docs, min_docs, min_chars).select(F.col("doc_id").alias(_ID), F.col("text_hash").alias(_TEXT_HASH), F.col("drops").alias(_DROPS))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.drop("kept_text", "n_lines", "n_dropped")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(_ID)) & (F.xxhash64(text) == F.col(_TEXT_HASH))
    rows = rows.join(drops, on, "left")
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")
    # Set difference and look-up by position take time linear in the lines of a text.
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col(_DROPS))
    kept = let(F.struct(_lines(F.col("text")).alias("lines"), stay.alias("stay")), lambda x: F.struct(F.array_join(F.transform(x["stay"], lambda i: F.get(x["lines"], i)), "\n").alias("text"), F.size(x["stay"]).alias("n")))
    rows = rows.withColumn(_KEPT, F.when(F.col(_DROPS).isNotNull(), kept))
    return rows.withColumns(
        {
            "kept_text": F.coalesce(F.col(_KEPT)["text"], text),
            "n_lines": n_lines.cast("long"),
            "n_dropped": F.coalesce(n_lines - F.col(_KEPT)["n"], F.lit(0)).cast("long"),
        }
    ).drop(_ID, _TEXT_HASH, _DROPS, _KEPT)
