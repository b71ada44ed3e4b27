"""Bi-temporal supersession of preferences and facts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

#: Candidates that a judge sees at most, most recent first.
MAX_CANDIDATES = 8

#: (old, new) -> (contradicts, confidence)
Judge = Callable[[dict, dict], tuple[bool, float]]


def recent_candidates(rows: DataFrame, keys: list[str], k: int = MAX_CANDIDATES) -> DataFrame:
    """The ``k`` most recent rows of each partition, with their 0-based rank; rows without a date come last."""
    order = Window.partitionBy(*keys).orderBy(F.coalesce("valid_from", "created_at").desc_nulls_last(), "id")
    return rows.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def supersede_by_rule(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The chain under the rule that a different statement contradicts the one before it.

    Adds valid_until, superseded_by and reason: a row ends where its successor begins.
    A row that repeats the statement before it changes nothing and is left out.
    """
    order = Window.partitionBy(*keys).orderBy("valid_from", "id")
    changed = rows.withColumn("__before", F.lag("statement").over(order)).where(F.col("__before").isNull() | (F.col("__before") != F.col("statement"))).drop("__before")
    out = changed.withColumns({"valid_until": F.lead("valid_from").over(order), "superseded_by": F.lead("id").over(order)})
    return out.withColumn("reason", F.when(F.col("superseded_by").isNotNull(), F.lit("contradiction")))


def supersede_by_judge(new: DataFrame, old: DataFrame, keys: list[str], judge: Judge) -> DataFrame:
    """id, superseded and confidence: for each new row the first recent candidate that the judge says it contradicts.

    A judge that fails, or says something else than a truth value and a number, finds no contradiction.
    """
    top = recent_candidates(old, keys)
    side = lambda df, p: df.select(*keys, F.struct(*[c for c in df.columns]).alias(p))
    pairs = side(new, "new").join(side(top, "old"), keys).where("new.id <> old.id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for n, o in zip(batch["new"], batch["old"], strict=True):
                try:
                    says, sure = judge(dict(o), dict(n))
                    says, sure = bool(says), min(1.0, max(0.0, float(sure)))
                except Exception:  # a failed call finds nothing
                    says, sure = False, 0.0
                rows.append((n["id"], o["id"], int(o["rank"]), says, sure))
            yield pd.DataFrame(rows, columns=["id", "superseded", "rank", "says", "confidence"])

    judged = pairs.select(F.struct("new.*").alias("new"), F.struct("old.*").alias("old")).mapInPandas(run, "id string, superseded string, rank int, says boolean, confidence double")
    first = judged.where("says").groupBy("id").agg(F.min_by(F.struct("superseded", "confidence"), "rank").alias("x"))
    return first.select("id", "x.superseded", "x.confidence")


def sweep(nodes: DataFrame, edges: DataFrame, since: Column, judge: Judge, now: Column, dry_run: bool = False, k: int = MAX_CANDIDATES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges after the contradictions of what changed since the last run, and the decisions.

    Nodes have id, user_id, type, properties, merged_into, valid_from, valid_until, created_at
    and updated_at; edges the columns that are written here, others are null in new rows.
    Current preferences are compared within their category, facts within subject and predicate.
    A row that changed after ``since`` is judged against the at most ``k`` rows before it (by
    valid_from, else creation, then id), the latest first; the first that it contradicts ends
    where it begins.  Rows without a slot are left alone, a judge that fails finds nothing, and
    a dry run calls no judge and writes nothing.  A second run finds those rows ended.
    """
    decided = "id string, superseded string, confidence double"
    if dry_run:
        return nodes, edges, nodes.sparkSession.createDataFrame([], decided)
    part = lambda name: F.nullif(F.lower(F.trim(F.element_at("properties", name))), F.lit(""))
    fact = F.when(part("subject").isNotNull() & part("predicate").isNotNull(), F.concat_ws("|", part("subject"), part("predicate")))
    slot = F.when(F.col("type") == "preference", part("category")).when(F.col("type") == "fact", fact)
    begins = F.coalesce("valid_from", "created_at")
    active = nodes.where((F.coalesce("merged_into", F.lit("")) == "") & F.col("valid_until").isNull()).withColumn("slot", slot).where("slot is not null")
    # Only the k rows before each row are held, so a slot with most rows is sorted but never collected.
    before = Window.partitionBy("user_id", "type", "slot").orderBy(begins.asc_nulls_first(), "id").rowsBetween(-k, -1)
    rows = active.withColumn("old", F.collect_list(F.struct("id", "type", "properties")).over(before))
    drivers = rows.where((F.col("updated_at") > since) & (F.size("old") > 0)).select(F.struct("id", "type", "properties").alias("new"), "old")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_dict = lambda x: {"id": x["id"], "type": x["type"], "properties": dict(x["properties"] or {})}
        for batch in batches:
            found = []
            for new, olds in zip(batch["new"], batch["old"], strict=True):
                for old in reversed(list(olds)):
                    try:
                        says, sure = judge(as_dict(old), as_dict(new))
                        says, sure = bool(says), min(1.0, max(0.0, float(sure)))
                    except Exception:  # a failed call finds nothing
                        says, sure = False, 0.0
                    if says:
                        found.append((new["id"], old["id"], sure))
                        break
            yield pd.DataFrame(found, columns=["id", "superseded", "confidence"])

    # Written once: the judge is not asked again for each table that reads its decisions.
    decisions = materialise(drivers.mapInPandas(run, decided), "supersessions")
    ends = nodes.select("id", "user_id", F.col("type").alias("kind"), F.coalesce("valid_from", now).alias("begins"))
    by = decisions.join(ends, "id")
    first = by.groupBy("superseded").agg(F.min_by(F.struct("id", "begins", "confidence", "user_id", "kind"), F.struct("begins", "id")).alias("x")).select("superseded", "x.*")
    ended = first.select(F.col("superseded").alias("id"), F.col("begins").alias("__end"))
    out = nodes.join(ended, "id", "left").withColumns({"valid_until": F.coalesce("valid_until", "__end"), "updated_at": F.when(F.col("__end").isNotNull(), now).otherwise(F.col("updated_at"))})
    slots = {"superseded_at": F.col("begins").cast("string"), "reason": F.lit("contradiction"), "judge_confidence": F.col("confidence").cast("string")}
    links = first.select(
        F.concat_ws("|", "superseded", F.lit("superseded_by"), "id").alias("id"), "user_id", F.lit("superseded_by").alias("type"), F.col("superseded").alias("source_node_id"), F.col("kind").alias("source_type"),
        F.col("id").alias("target_node_id"), F.col("kind").alias("target_type"), F.create_map(*[x for n, v in slots.items() for x in (F.lit(n), v)]).alias("properties"),
    ).join(edges.select("id"), "id", "left_anti")
    return out.select(*nodes.columns), edges.unionByName(links, allowMissingColumns=True).select(*edges.columns), first.select("id", "superseded", "confidence")


def has_edges(preferences: DataFrame) -> DataFrame:
    """One ``has`` edge from the tenant's own person to each preference."""
    me = F.concat_ws(":", "user_id", F.lit("person"), F.lit("self"))
    rows = preferences.select("user_id", me.alias("source_node_id"), F.col("id").alias("target_node_id")).distinct()
    return rows.withColumn("id", F.concat_ws("|", "source_node_id", F.lit("has"), "target_node_id"))
