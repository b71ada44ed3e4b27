"""The online path: each micro-batch of documents goes through the whole write path and is committed once.

Tables are folders of deltas.  A commit writes the changed rows of all tables to a new
folder and then one line into a ledger; readers take only what the ledger names, and of
each key the newest delta.  So all tables of a micro-batch change together or not at all,
and a batch that comes again after a failure finds itself in the ledger or starts anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ingestion, writes
from ..operators.search import node_text, terms
from ..storage import materialise

_LEDGER = "place long, batch long, base boolean, path string"
#: Tables of the path and what a row of each is known by.
KEYS = {"documents": ["user_id", "source_uri"], "nodes": ["id"], "edges": ["id"], "terms": ["id"], "rejected": ["user_id", "source_uri"], "dropped": ["user_id", "source_uri"], "failed": ["user_id", "source_uri"]}


@dataclass(frozen=True)
class Tables:
    """Versioned tables below a folder that driver and executors share."""

    spark: SparkSession
    folder: str

    @classmethod
    def create(cls, spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> Tables:
        """New tables with these rows; an existing ledger is kept as it is."""
        made = cls(spark, folder.rstrip("/"))
        made._write(0, -1, True, tables)
        return made

    def ledger(self) -> list[tuple[int, int, bool, str]]:
        """place, batch, base and path of each commit, one a micro-batch since the tables were made."""
        rows = self.spark.read.schema(_LEDGER).json(f"{self.folder}/ledger").collect()
        return sorted(tuple(r) for r in rows)

    def has(self, batch: int) -> bool:
        return any(b == batch for _, b, _, _ in self.ledger())

    def read(self, name: str) -> DataFrame:
        """The newest rows of each key; without a key all rows."""
        rows = self._rows(name)
        newest = F.max("__place").over(Window.partitionBy(*KEYS[name]))
        return rows.withColumn("__newest", newest).where(F.col("__place") == F.col("__newest")).drop("__place", "__newest")

    def _rows(self, name: str) -> DataFrame:
        found = self.ledger()
        base = max(i for i, (_, _, is_base, _) in enumerate(found) if is_base)
        return self.spark.read.parquet(*[f"{path}/{name}" for _, _, _, path in found[base:]])

    def _write(self, place: int, batch: int, base: bool, tables: dict[str, DataFrame]) -> None:
        path = f"{self.folder}/data/{place:012}-{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.withColumn("__place", F.lit(place).cast("long")).write.parquet(f"{path}/{name}")
        # One line in one file: it is there as a whole or not at all.
        line = self.spark.createDataFrame([(place, batch, base, path)], _LEDGER)
        line.coalesce(1).write.mode("append").json(f"{self.folder}/ledger")

    def commit(self, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Write the changed rows of all tables under a batch; a batch that was committed changes nothing."""
        found = self.ledger()
        if any(b == batch for _, b, _, _ in found):
            return False
        self._write(found[-1][0] + 1, batch, False, tables)
        return True

    def compact(self) -> None:
        """One delta in place of all: later reads start from it."""
        found = self.ledger()
        self._write(found[-1][0] + 1, found[-1][1], True, {name: self.read(name) for name in KEYS})


def node_terms(nodes: DataFrame) -> DataFrame:
    """id, n_terms and the terms of each node's search text: what the text index takes from it."""
    rows = nodes.select("id", terms(node_text(nodes.columns)).alias("terms"))
    return rows.select("id", F.size("terms").alias("n_terms"), "terms")


def ingest_batch(tables: Tables, batch: DataFrame, batch_id: int, extractor: ingestion.Extractor, now: datetime | None = None, **how) -> bool:
    """One micro-batch of documents (the columns of the table) through ingest, extraction, validation, writes and index.

    Only documents that are new or replace a latent one are extracted.  Whatever fails
    before the ledger's line leaves the tables as they were.
    """
    if tables.has(batch_id):
        return False
    at = F.lit(now or datetime.now(UTC)).cast("timestamp")
    merged = writes.upsert_documents(tables.read("documents"), batch)
    came = materialise(merged.where(F.col("outcome").isin("inserted", "replaced")).drop("outcome"), "documents")
    nodes, edges = tables.read("nodes"), tables.read("edges")
    got = ingestion.ingest_documents(came, nodes, edges, extractor, at, **how)
    # Rows that this batch has touched carry its time.
    changed = materialise(got.nodes.where(F.col("updated_at") == at), "changed")
    return tables.commit(
        batch_id,
        {"documents": came, "nodes": changed, "edges": got.edges.where(F.col("updated_at") == at), "terms": node_terms(changed), "rejected": got.rejected, "dropped": got.dropped, "failed": got.failed},
    )


def online_path(stream: DataFrame, tables: Tables, extractor: ingestion.Extractor, checkpoint: str, clock: Callable[[int], datetime] | None = None, **how):
    """Run ``ingest_batch`` on each micro-batch of a stream of documents."""

    def each(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(tables, batch, batch_id, extractor, None if clock is None else clock(batch_id), **how)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
