"""Upserts of documents, nodes and edges, as joins whose result is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import capped_union
from .grouping import first_values, merged_properties


def upsert_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """All documents after an ingest, each with ``outcome``: kept, inserted, replaced or skipped.

    A new uri is inserted, a latent one is replaced by the record that it stood for, and
    any other stays as it is.  Keys are (user_id, source_uri); the first of equal incoming
    keys counts.
    """
    keys = ["user_id", "source_uri"]
    fields = [c for c in current.columns if c not in keys]
    new = incoming.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("new"))
    rows = current.select(*keys, F.struct(*fields).alias("old")).join(new, keys, "full_outer")
    outcome = (
        F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept")
        .when(F.col("old.source_type") == "latent", "replaced").otherwise("skipped")
    )
    rows = rows.withColumn("outcome", outcome)
    row = F.when(F.col("outcome").isin("inserted", "replaced"), F.col("new")).otherwise(F.col("old"))
    return rows.select(*keys, "outcome", row.alias("row")).select(*keys, "outcome", "row.*")


def latent_documents(references: DataFrame, documents: DataFrame) -> DataFrame:
    """Placeholders for referenced uris that no document has yet: user_id and source_uri."""
    return references.select("user_id", "source_uri").distinct().join(documents.select("user_id", "source_uri"), ["user_id", "source_uri"], "left_anti")


def upsert_nodes(current: DataFrame, incoming: DataFrame, now, max_aliases: int = 50, max_sources: int = 500) -> DataFrame:
    """Nodes after an upsert: properties merged (the last incoming wins), aliases and sources united.

    Creation stays, update is ``now`` where a row came in.  Incoming rows have id, name,
    properties, aliases, sources, seq (their order) and are collapsed by id before the join;
    aliases and sources are limited in each task before they are shuffled.
    """
    empty = F.create_map().cast("map<string,string>")
    new = incoming.groupBy("id").agg(F.max_by("name", "seq").alias("n_name"))
    new = new.join(merged_properties(incoming, "id", F.struct("seq", "value")).withColumnRenamed("properties", "n_properties"), "id", "left")
    for values, limit in (("aliases", max_aliases), ("sources", max_sources)):
        each = incoming.select("id", F.explode(values).alias("value"))
        new = new.join(first_values(each, "id", F.col("value"), limit, f"n_{values}"), "id", "left")
    rows = current.join(new, "id", "full_outer")
    old, add = F.coalesce("properties", empty), F.coalesce("n_properties", empty)
    return rows.select(
        "id", F.coalesce("n_name", "name").alias("name"),
        F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(add, k)), add).alias("properties"),
        capped_union(F.col("aliases"), F.col("n_aliases"), max_aliases).alias("aliases"),
        capped_union(F.col("sources"), F.col("n_sources"), max_sources).alias("sources"),
        F.coalesce("created_at", now).alias("created_at"), F.when(F.col("n_name").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def pending_documents(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Documents with content that no node names as a source, in order."""
    used = nodes.select(F.explode("sources").alias("doc_id")).distinct()
    return documents.where(F.coalesce("content", F.lit("")) != "").join(used, "doc_id", "left_anti").orderBy("doc_id")


def watermark(states: DataFrame, user_id: str, job: str) -> DataFrame:
    """last_run_at of a job, the epoch if it never ran: one row."""
    found = states.where((F.col("user_id") == user_id) & (F.col("job") == job)).agg(F.max("last_run_at").alias("last_run_at"))
    return found.select(F.coalesce("last_run_at", F.timestamp_seconds(F.lit(0))).alias("last_run_at"))


def record_run(states: DataFrame, runs: DataFrame) -> DataFrame:
    """States after runs, each with the START of its run, so that what changed during a run is seen again."""
    both = states.select("user_id", "job", "last_run_at").unionByName(runs.select("user_id", "job", F.col("started_at").alias("last_run_at")))
    return both.groupBy("user_id", "job").agg(F.max("last_run_at").alias("last_run_at"))
