"""Aggregates that stay small before and after the shuffle, and joins that stay out of the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is shuffled and merged, whatever its size is held to be.

    Files of ids pack so well that Spark takes millions of rows for less than the size up to
    which it collects a side in the driver and sends it whole to every executor.
    """
    return side.hint("merge")


#: Rows of ids that are sent whole to every executor: some tens of MB.
FEW = 500_000


def sent_or_shuffled(side: DataFrame, rows: int) -> DataFrame:
    """A side of a join that has ``rows`` rows at most: sent whole if these are few, otherwise shuffled.

    Rows are counted from the files of written tables, whose packed size says little.
    """
    return F.broadcast(side) if rows <= FEW else shuffled(side)


def first_values(rows: DataFrame, key: str, value: Column, limit: int, name: str) -> DataFrame:
    """The first ``limit`` distinct values of each key as an array.

    The limit holds in each task before the shuffle, so a key with most of the rows sends little.
    """
    order = Window.partitionBy(key).orderBy("value")
    some = rows.select(key, value.alias("value")).where("value is not null").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return shuffled(some.groupBy(key).agg(F.array_sort(F.collect_list("value")).alias(name)))


def merged_properties(rows: DataFrame, key: str, best: Column) -> DataFrame:
    """One map a key: of the values of a property the one with the greatest ``best``, aggregated before the shuffle."""
    each = rows.select(key, "seq", F.explode("properties").alias("field", "value")).where("value is not null")
    each = each.groupBy(key, "field").agg(F.max_by("value", best).alias("value"))
    return shuffled(each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("properties")))
