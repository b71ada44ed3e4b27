"""Keyed state that outlives micro-batches: vectors of names, and what a run has seen."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import normalize_name
from ..operators.batching import MAX_INPUTS, embed_resilient

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Embedder = Callable[[list[str]], list[list[float]]]


def keyed_state(spark: SparkSession) -> None:
    """State with several columns and a time to live needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


class _Vectors(StatefulProcessor):
    """The vectors of the names of one shard; the model is asked for the names that are new to it, many at a time."""

    def __init__(self, embed: Embedder, ttl_ms: int | None):
        self.embed, self.ttl_ms = embed, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.vectors = handle.getMapState("vectors", "name string", "vector array<double>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = sorted({name for frame in rows for name in frame["name"]})
        known = {n: list(self.vectors.getValue((n,))[0]) for n in names if self.vectors.containsKey((n,))}
        new = [n for n in names if n not in known]
        for at in range(0, len(new), MAX_INPUTS):
            part = new[at : at + MAX_INPUTS]
            for name, vector in zip(part, embed_resilient(part, self.embed), strict=True):
                vector = [float(x) for x in vector]
                # A refused name is asked for again when it comes again.
                if vector:
                    self.vectors.updateValue((name,), (vector,))
                known[name] = vector
        if names:
            yield pd.DataFrame({"name": names, "embedding": [known[n] for n in names], "cached": [n not in set(new) for n in names]})

    def close(self) -> None:
        pass


def embedded_names(stream: DataFrame, embed: Embedder, name: str = "name", shards: int = 64, ttl_ms: int | None = None) -> DataFrame:
    """name (normalised), embedding and cached for each distinct name of a micro-batch.

    A name is embedded once, in whichever micro-batch it comes first, also over restarts
    of the stream, until it was not renewed for ``ttl_ms`` (never, without).  Names are
    dealt over ``shards`` by a hash, so a frequent name is one entry of one shard and the model is asked for
    many names at a time.  Null names are left out; a name that the model refuses has no vector.
    """
    keyed_state(stream.sparkSession)
    rows = stream.where(F.col(name).isNotNull()).select(normalize_name(F.col(name)).alias("name"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int"))
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return rows.groupBy("shard").transformWithStateInPandas(_Vectors(embed, ttl_ms), "name string, embedding array<double>, cached boolean", "Update", mode)


class _FirstSeen(StatefulProcessor):
    def __init__(self, names: list[str], ttl_ms: int | None):
        self.names, self.ttl_ms = names, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        if not self.seen.exists():
            self.seen.update((True,))
            yield pd.DataFrame([key], columns=self.names)

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, keys: list[str], ttl_ms: int | None = None) -> DataFrame:
    """Each distinct value of ``keys`` (a run and an id) in the micro-batch in which it comes first, and never again.

    Restarts of the stream remember.  With ``ttl_ms`` a key is forgotten that long after it was first seen.
    """
    keyed_state(stream.sparkSession)
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    rows = stream.select(*keys)
    return rows.groupBy(*keys).transformWithStateInPandas(_FirstSeen(keys, ttl_ms), schema, "Update", "None" if ttl_ms is None else "ProcessingTime")
