"""Helpers that the training-text operators share."""

from __future__ import annotations

import functools
import itertools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..storage import materialise, shared_folder

__all__ = ["SPACE", "NOT_SPACE", "SPACE_CHARS", "ascii_lower", "bound_batches", "file_order", "join_groups", "let", "materialise", "own_names", "shared_folder", "within_budget"]

#: The white space of the contracts, ``[\x20\x09-\x0D]``.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: At most so many keys can each hold a thousandth of all rows.
HEAVY_KEYS = 1000


#: Bytes of a batch of texts that a Python worker gets, if one text alone is not longer.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by bytes, as texts may be long; a tighter bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not re.fullmatch(r"\d+b?", now := spark.conf.get(name)) or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row.

    Adjacent projections are merged by the optimizer, which would otherwise
    evaluate an expensive expression inside a lambda again and again.
    """
    return F.transform(F.array(value), body)[0]


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """Join ``rows`` to ``groups``, one row a key, when a few keys may hold most rows.

    ``groups[weight]`` is the number of rows of its key.  Keys with more than a
    thousandth of the weight are fewer than ``HEAVY_KEYS`` by arithmetic, so they
    are broadcast; all others are joined by a shuffle in which no key is heavy.
    Keys are compared null-safely.  ``how`` is ``left`` or ``inner``.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HEAVY_KEYS > F.lit(total)
    heavy_groups = groups.where(heavy).withColumn("__heavy", F.lit(True))

    def joined(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
        named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        return left.join(named, on, kind).drop(*[f"__{k}" for k in keys])

    marked = joined(rows, F.broadcast(heavy_groups), "left")
    hot = marked.where(F.col("__heavy").isNotNull()).drop("__heavy")
    rest = marked.where(F.col("__heavy").isNull()).select(*rows.columns)
    return hot.unionByName(joined(rest, groups.where(~heavy), how))


def within_budget(sizes: list[tuple], budget: int) -> list:
    """The keys of ``(key, size)`` in their order, as long as sizes fit into what is left; larger ones are passed over."""
    taken = []
    for key, size in sizes:
        if size <= budget:
            taken.append(key)
            budget -= size
    return taken


def file_order(docs: DataFrame) -> Column | None:
    """The place of each row in the files that ``docs`` was read from, from 0 in the order of their names.

    Spark reads files in any order, packed as it likes, but a sorted write numbers them.
    None where ``docs`` is not read from files.
    """
    try:
        files = docs.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return None
    counts = files.groupBy("file").agg((F.max("row") + 1).alias("n")).collect()
    number = lambda r: (int((re.findall(r"part-(\d+)", r["file"]) or ["0"])[0]), r["file"])
    before, known = 0, []
    for r in sorted(counts, key=number):
        known += [F.lit(r["file"]), F.lit(before)]
        before += r["n"]
    # One entry a file of the table.
    return F.create_map(*known)[F.col("_metadata.file_name")].cast("long") + F.col("_metadata.row_index") if known else F.lit(None).cast("long")


def own_names(stage):
    """A stage that returns the columns of ``docs`` may use names with two underscores: a table's own ones are put aside meanwhile."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **kw) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        free = (n for n in (f"own_column_{i}" for i in itertools.count()) if n not in taken)
        aside = {c: next(free) for c in docs.columns if c.startswith("__")}
        if not aside:
            return stage(docs, *args, **kw)
        return stage(docs.withColumnsRenamed(aside), *args, **kw).withColumnsRenamed({v: k for k, v in aside.items()})

    return run
