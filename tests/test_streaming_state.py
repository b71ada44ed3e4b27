"""Streams that are stopped, killed and started again."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from lorekeeper.streaming import online, state

from .test_ingestion import EDGE, NODE, talk

NAMES = "name string"


@pytest.fixture
def folders(tmp_path):
    made = {k: str(tmp_path / k) for k in ("in", "checkpoint", "calls", "tables")}
    for k in ("in", "calls"):
        os.makedirs(made[k])
    return made


def put(folder, name, rows):
    with open(f"{folder}/{name}.tmp", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    # Streams take files in the order of their times, which a fast test would leave equal.
    at = 1_700_000_000 + len(os.listdir(folder))
    os.utime(f"{folder}/{name}.tmp", (at, at))
    os.rename(f"{folder}/{name}.tmp", f"{folder}/{name}.json")


def run(df, checkpoint, found):
    query = df.writeStream.foreachBatch(lambda batch, _: found.extend(batch.collect())).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_names_are_embedded_once_over_restarts(spark, folders):
    calls = folders["calls"]

    def embed(names):
        if "bad" in names:
            raise ValueError("refused")
        with open(f"{calls}/{os.getpid()}-{len(os.listdir(calls))}-{abs(hash(tuple(names)))}", "w") as f:
            json.dump(names, f)
        return [[float(len(n)), 1.0] for n in names]

    def names(*values):
        put(folders["in"], f"f{len(os.listdir(folders['in']))}", [{"name": v} for v in values])

    def once():
        stream = spark.readStream.schema(NAMES).option("maxFilesPerTrigger", 1).json(folders["in"])
        found = []
        run(state.embedded_names(stream, embed, shards=2), folders["checkpoint"], found)
        return [(r.name, r.embedding, r.cached) for r in found]

    def asked():
        return sorted(n for f in os.listdir(calls) for n in json.load(open(f"{calls}/{f}")))

    names("Ann", " ann ", "Bob", None, "bad")
    names("ANN", "Cid")
    first = once()
    assert sorted(first) == [("ann", [3.0, 1.0], False), ("ann", [3.0, 1.0], True), ("bad", [], False), ("bob", [3.0, 1.0], False), ("cid", [3.0, 1.0], False)]
    assert asked() == ["ann", "bob", "cid"]
    names("bob", "Dora", "cid")
    assert sorted(once()) == [("bob", [3.0, 1.0], True), ("cid", [3.0, 1.0], True), ("dora", [4.0, 1.0], False)]
    assert asked() == ["ann", "bob", "cid", "dora"]


def test_a_run_sees_each_pair_once(spark, folders):
    def once():
        stream = spark.readStream.schema("run string, id long").option("maxFilesPerTrigger", 1).json(folders["in"])
        found = []
        run(state.first_seen(stream, ["run", "id"]), folders["checkpoint"], found)
        return sorted((r.run, r.id) for r in found)

    put(folders["in"], "a", [{"run": "x", "id": 1}, {"run": "x", "id": 1}, {"run": "y", "id": 1}])
    put(folders["in"], "b", [{"run": "x", "id": 1}, {"run": "x", "id": 2}])
    assert once() == [("x", 1), ("x", 2), ("y", 1)]
    put(folders["in"], "c", [{"run": "y", "id": 1}, {"run": "y", "id": 3}])
    assert once() == [("y", 3)]


DOCUMENT = "user_id string, source_uri string, source_type string, content string"
BATCHES = [
    [("u", "d1", "web", "person Ann email=a@b ; person Bob shoe=4 ; Ann knows Bob")],
    [("u", "d1", "web", "person Ghost"), ("u", "d2", "web", "person Cid ; Cid knows Ann"), ("v", "d1", "web", "person Ann")],
    [("u", "d3", "web", "fail"), ("u", "d4", "web", "likes Tea food")],
]


def fresh(spark, folder):
    empty = {"documents": DOCUMENT, "nodes": NODE, "edges": EDGE, "terms": "id string, n_terms int, terms array<string>"}
    tables = {k: spark.createDataFrame([], v) for k, v in empty.items()}
    audit = "user_id string, source_uri string, seq long"
    tables |= {"rejected": spark.createDataFrame([], f"{audit}, kind string, type string, name string, reason string"), "failed": spark.createDataFrame([], f"{audit}, error string")}
    tables["dropped"] = spark.createDataFrame([], f"{audit}, kind string, id string, type string, field string, value string, reason string")
    return online.Tables.create(spark, folder, tables)


def content(tables):
    return {name: sorted(repr(r.asDict()) for r in tables.read(name).collect()) for name in online.KEYS}


def clock(_):
    return datetime.datetime(2024, 6, 1, tzinfo=datetime.UTC)


class Killed(RuntimeError):
    pass


def test_a_stream_killed_between_its_tables_gives_the_tables_of_one_run(spark, folders, tmp_path, monkeypatch):
    for i, rows in enumerate(BATCHES):
        put(folders["in"], f"b{i}", [dict(zip(("user_id", "source_uri", "source_type", "content"), r, strict=True)) for r in rows])
    stream = lambda: spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", 1).json(folders["in"])
    tables = fresh(spark, f"file://{folders['tables']}")
    write = online.Tables._write

    def dies(after):
        def half(self, place, batch, base, rows):
            if batch != 1:
                return write(self, place, batch, base, rows)
            if after == "ledger":
                write(self, place, batch, base, rows)
            else:
                for name in list(rows)[:after]:
                    rows[name].withColumn("__place", F.lit(place)).write.parquet(f"{self.folder}/data/half-{after}/{name}")
            raise Killed

        return half

    for after in (2, "ledger"):
        monkeypatch.setattr(online.Tables, "_write", dies(after))
        with pytest.raises(Exception, match="Killed"):
            online.online_path(stream(), tables, talk, folders["checkpoint"], clock).awaitTermination()
        assert len(tables.ledger()) == (2 if after == 2 else 3)
    monkeypatch.setattr(online.Tables, "_write", write)
    online.online_path(stream(), tables, talk, folders["checkpoint"], clock).awaitTermination()
    assert [b for _, b, _, _ in tables.ledger()] == [-1, 0, 1, 2]

    whole = fresh(spark, f"file://{tmp_path}/whole")
    rows = [r for i, b in enumerate(BATCHES) for r in b if not (i and r[:2] == ("u", "d1"))]
    assert online.ingest_batch(whole, spark.createDataFrame(rows, DOCUMENT), 7, talk, clock(0))
    assert content(tables) == content(whole)
    assert not online.ingest_batch(whole, spark.createDataFrame(rows, DOCUMENT), 7, talk, clock(0))
    tables.compact()
    assert content(tables) == content(whole)
