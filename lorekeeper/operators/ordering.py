"""Ranks over whole tables, as-of joins and first records, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .grouping import shuffled

_INSIDE = (1 << 33) - 1


def global_rank(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """The rows with their 0-based rank in the order, which should have no ties, over the whole table.

    Rows are sorted by ranges; a row's rank is its place in its range after the ranges before,
    whose sizes are one row a partition.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = materialise(placed, "ranked").withColumns({"__range": F.shiftright("__id", 33), "__in": F.col("__id").bitwiseAND(F.lit(_INSIDE))})
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = placed.join(F.broadcast(sizes), "__range").withColumn(name, F.col("__before") + F.col("__in"))
    return ranked.select(*df.columns, name)


def even_shard(rank: Column, total: Column, shards: int) -> Column:
    """The shard of a rank among ``total`` rows: equal sizes, the first ones larger by one, never more than rows."""
    size, more = F.floor(total / shards), total % shards
    wide = more * (size + 1)
    return F.when(rank < wide, F.floor(rank / (size + 1))).otherwise(more + F.floor((rank - wide) / F.greatest(size, F.lit(1)))).cast("int")


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str]) -> DataFrame:
    """Each left row with ``values`` of the last right row of its ``by`` at or before its ``time``; null where there is none.

    Both tables are united and read once in the order of time, so no pair of rows is made;
    of right rows at the same time the one with the greatest values counts.
    """
    mark = F.struct(*[F.col(v) for v in values])
    a = left.select(F.struct(*left.columns).alias("__row"), *by, time, F.lit(None).cast(right.select(mark.alias("x")).schema["x"].dataType).alias("__seen"))
    b = right.select(F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), *by, time, mark.alias("__seen"))
    w = Window.partitionBy(*by).orderBy(time, F.col("__row").isNotNull(), "__seen").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("__last", F.last("__seen", ignorenulls=True).over(w)).where("__row is not null")
    return both.select("__row.*", *[F.col("__last")[v].alias(v) for v in values])


def first_records(keys: DataFrame, records: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Each row of ``keys`` with ``fields`` of its first record, null where it has none."""
    first = records.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("__first"))
    return keys.join(first, key, "left").select(*keys.columns, *[F.col("__first")[f].alias(f) for f in fields])


def blocked_pairs(left: DataFrame, right: DataFrame, block: list[str], condition: Column) -> DataFrame:
    """Pairs of one block that fulfil a condition on columns of both: an equi-join first, the condition in it."""
    return left.join(right, block).where(condition)


def banded_pairs(left: DataFrame, right: DataFrame, block: list[str], a: str, b: str, width: int) -> DataFrame:
    """Pairs of one block whose values, ``a`` of the left and ``b`` of the right, differ by ``width`` at most.

    Values lie in bands of ``2 * width + 1``; a left row meets the one or two bands that its
    pairs can lie in, so a block of any size costs what its near pairs do.
    """
    size = 2 * width + 1
    band = lambda c: F.floor(c / size)
    near = left.withColumn("__band", F.explode(F.array_distinct(F.array(band(F.col(a) - width), band(F.col(a) + width)))))
    pairs = near.join(shuffled(right.withColumn("__band", band(F.col(b)))), [*block, "__band"])
    return pairs.where(F.abs(F.col(a) - F.col(b)) <= width).drop("__band")


def merged_fields(base: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """``base`` with each field that its row of ``override`` has in its place; a null overrides nothing."""
    fields = [c for c in base.columns if c != key]
    new = override.select(key, *[F.col(c).alias(f"__{c}") for c in fields if c in override.columns])
    known = [c for c in fields if f"__{c}" in new.columns]
    return base.join(new, key, "left").select(key, *[F.coalesce(f"__{c}", c).alias(c) if c in known else F.col(c) for c in fields])
