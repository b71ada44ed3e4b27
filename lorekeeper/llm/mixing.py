"""Mixing sources to target weights along a time-varying curriculum, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, materialise, own_names

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: The weight of source number i moves linearly from its first to its second value
#: over the run; numbers repeat.  Only the course of a source matters, its total
#: demand is its target.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Hash ranges in which each source's words are summed before the running sums.
RANGES = 4096


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, the number of words of the whole text."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(NOT_SPACE + "+"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """source, rank, weight, source_size and target, one row a source.

    Sources are ranked by code point, null last.  All targets together are all
    words.  A target stops at ``cap`` times its source's size; the excess goes to
    the others by weight.  With sources in the order of size over weight, source k
    is capped exactly if the share that is left for it and those after it reaches
    its cap, so running sums give the level at which the excess settles.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    w = ranked.withColumn("weight", weight)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    w = w.withColumn("level", level)
    capped = F.col("level") * F.col("weight") >= cap * F.col("source_size")
    w = w.withColumn("final_level", F.max(F.when(~capped, F.col("level"))).over(everything))
    target = F.when(capped, (cap * F.col("source_size")).cast("double")).otherwise(F.col("final_level") * F.col("weight"))
    return w.select("source", "rank", "weight", "source_size", target.alias("target"))


def _when(share: Column, start: Column, end: Column) -> Column:
    """The time at which a schedule from ``start`` to ``end`` has used ``share`` of its demand.

    The integral of the linear schedule is ``start t + (end - start) t^2 / 2``; its
    inverse is the root of a quadratic, written so that equal ends do not divide by 0.
    """
    mean, slope = (start + end) / 2, end - start
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * share * mean / (start + F.sqrt(start * start + 2 * slope * share * mean))))


def curriculum(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = MAX_EPOCHS,
    schedules: tuple[tuple[float, float], ...] = SCHEDULES,
    seed: int = 0,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and ``positions``, one row a document.

    The documents of a source follow each other in the order of a seeded hash, epoch
    after epoch.  A copy is taken if the middle of its words lies before the source's
    target, so a source's words miss its target by half a document at most and no
    document is taken more than ``cap`` times.  ``positions`` has the training time in
    [0, 1] of each copy taken: the time at which the source's schedule has asked for
    the words before it.  Ties of the hash are broken by doc_id and size, so reruns
    agree; a null doc_id is a document like others, documents without words are never
    taken, and a null source is a source.
    """
    sizes = materialise(document_sizes(docs), "sizes")
    targets = source_targets(sizes, weights, cap)
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    rows = sizes.withColumn("hash", hashed).withColumn("range", F.conv(F.substring("hash", 1, 3), 16, 10).cast("int"))
    rows = rows.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    ranges = rows.groupBy("source_key", "source", "range").agg(F.sum("size").alias("range_size"))
    to_here = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(to_here), F.lit(0)))
    known = targets.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    ranges = ranges.drop("source", "range_size").join(known, "source_key")
    inside = Window.partitionBy("source_key", "range").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, ["source_key", "range"])
    middle = F.col("before") + F.col("inside") + F.col("size") / 2.0
    epochs = [F.when((F.col("size") > 0) & (middle + e * F.col("source_size") < F.col("target")), middle + e * F.col("source_size")) for e in range(cap)]
    at = F.filter(F.array(*epochs), lambda x: x.isNotNull())
    part = lambda i: F.element_at(F.array(*[F.lit(float(s[i])) for s in schedules]), (F.col("rank") % len(schedules) + 1).cast("int"))
    rows = rows.withColumn("at", at)
    positions = F.transform("at", lambda x: _when(x / F.col("target"), part(0), part(1)))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("at")).cast("long").alias("taken"), positions.alias("positions"))


@own_names
def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, once a copy, in the order of training.

    Same columns as ``docs``.  Rows that agree in doc_id, source and size share the
    positions of those rows in the plan, one list each.
    """
    def keyed(rows: DataFrame, size: Column) -> DataFrame:
        """``rows`` with keys that are never null, so that the join and the ranks share one shuffle."""
        known = {"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__no_id": F.col("doc_id").cast("long").isNull()}
        known |= {"__source": F.coalesce(F.col("source").cast("string"), F.lit("")), "__no_source": F.col("source").isNull(), "__size": size}
        return rows.withColumns(known)

    keys = ["__id", "__no_id", "__source", "__no_source", "__size"]
    plan = keyed(curriculum(docs, **options).where("taken > 0"), F.col("size")).groupBy(*keys).agg(F.sort_array(F.collect_list("positions")).alias("__lists"))
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(NOT_SPACE + "+")).cast("long")
    rows = keyed(docs, words).withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("text")))
    taken = rows.join(plan, keys).withColumn("__at", F.explode(F.get("__lists", F.col("__k") - 1)))
    return taken.orderBy("__at", "doc_id").select(*docs.columns)
