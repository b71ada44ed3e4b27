"""Property schemas, the supersession sweep and the tools over a tenant's memory."""

import pytest
from pyspark.sql import functions as F

from lorekeeper.functions.ontology import ONTOLOGY, Ontology
from lorekeeper.memory import Memory, resolve_user
from lorekeeper.operators import supersession, validation

NODE = "id string, user_id string, type string, name string, canonical_name string, aliases array<string>, sources array<string>, properties map<string,string>, confidence double, merged_into string, merged_at timestamp, created_at timestamp"
EDGE = "id string, user_id string, type string, semantic_type string, source_node_id string, source_type string, target_node_id string, target_type string, properties map<string,string>"


def test_schemas_of_subtypes_and_edges(spark):
    assert "external_ref" in ONTOLOGY.node_fields("object", "project") and "external_ref" not in ONTOLOGY.node_fields("object", "task")
    assert ONTOLOGY.edge_fields("related_to", "knows") == {} and "role" in ONTOLOGY.edge_fields("related_to", "employed_by")
    own = Ontology()
    own.register_properties("robot", {"serial": None})
    with pytest.raises(ValueError):
        own.register_properties("robot", {"other": None})
    rows = spark.createDataFrame([("e", "related_to", "knows", {"role": "x"}), ("f", "related_to", "involved", {"role": "x", "z": "1"}), ("g", "same_as", None, {"status": "maybe", "confidence": None}), ("h", "has", None, None)], "id string, type string, semantic_type string, properties map<string,string>")
    kept, dropped = validation.split_schema(rows, edges=True)
    assert {r.id: r.properties for r in kept.collect()} == {"e": {}, "f": {"role": "x"}, "g": {"confidence": None}, "h": None}
    assert {(r.id, r.field, r.value, r.reason) for r in dropped.collect()} == {("e", "role", "x", "unknown_field"), ("f", "z", "1", "unknown_field"), ("g", "status", "maybe", "invalid_value")}


def test_supersession_sweep(spark):
    ts = lambda d: F.lit(f"2024-01-{d:02}").cast("timestamp")
    rows = [("p1", "preference", {"category": "food", "statement": "tea"}, 1), ("p2", "preference", {"category": "Food ", "statement": "coffee"}, 2), ("p3", "preference", {"category": "ui", "statement": "dark"}, 3), ("p4", "preference", {"statement": "x"}, 4)]
    rows += [("f1", "fact", {"subject": "a", "predicate": "in", "object": "x"}, 1), ("f2", "fact", {"subject": "a", "predicate": "in", "object": "fail"}, 2), ("q", "person", {"category": "food"}, 5)]
    nodes = spark.createDataFrame(rows, "id string, type string, properties map<string,string>, day int")
    date = F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0))
    none = F.lit(None)
    nodes = nodes.select("id", F.lit("u").alias("user_id"), "type", "properties", none.cast("string").alias("merged_into"), date.alias("valid_from"), none.cast("timestamp").alias("valid_until"), date.alias("created_at"), date.alias("updated_at"))
    edges = spark.createDataFrame([], EDGE)

    def judge(old, new):
        if new["properties"].get("object") == "fail":
            raise RuntimeError
        return True, 7

    out, links, found = supersession.sweep(nodes, edges, ts(1), judge, ts(20))
    assert [(r.superseded, r.id, r.confidence) for r in found.collect()] == [("p1", "p2", 1.0)]
    ended = {r.id: r.valid_until.day for r in out.where("valid_until is not null").collect()}
    assert ended == {"p1": 2} and out.count() == 7
    assert [(r.id, r.properties["reason"]) for r in links.collect()] == [("p1|superseded_by|p2", "contradiction")]
    again = supersession.sweep(out, links, ts(1), judge, ts(20))
    assert again[2].count() == 0 and again[1].count() == 1
    assert supersession.sweep(nodes, edges, ts(5), judge, ts(20))[2].count() == 0
    dry = supersession.sweep(nodes, edges, ts(1), judge, ts(20), dry_run=True)
    assert dry[0] is nodes and dry[1] is edges and dry[2].count() == 0
    assert supersession.sweep(nodes.where("false"), edges, ts(1), judge, ts(20))[0].count() == 0


@pytest.fixture
def memory(spark):
    person = lambda i, name, user="u": (i, user, "person", name, name, [], ["s"], {"city": name}, 1.0, None, None, None)
    nodes = spark.createDataFrame([person("a", "ada"), person("b", "adah"), person("c", "ada", "v")], NODE)
    same = ("a|same_as|b", "u", "same_as", None, "a", "person", "b", "person", {"status": "pending", "confidence": "0.9"})
    edges = spark.createDataFrame([same, ("b|related_to|z", "u", "related_to", "uses", "b", "person", "z", "object", {})], EDGE)
    return Memory("u", nodes, edges)


def test_reviews(memory):
    now = F.lit("2024-06-01").cast("timestamp")
    nodes, edges = memory.confirm("a|same_as|b", now)
    assert {r.id: r.merged_into for r in nodes.collect()} == {"a": None, "b": "a"}
    got = {r.id: r.properties for r in edges.collect()}
    assert set(got) == {"a|same_as|b", "a|related_to|z"} and got["a|same_as|b"]["status"] == "confirmed"
    again = Memory("u", nodes, edges).confirm("a|same_as|b", now)
    assert {r.id: r.merged_into for r in again[0].collect()} == {"a": None, "b": "a"} and again[1].count() == 2
    with pytest.raises(Exception, match="decided otherwise"):
        Memory("u", nodes, edges).reject("a|same_as|b").collect()
    assert {r.properties.get("status") for r in memory.reject("a|same_as|b").collect()} == {"rejected", None}
    with pytest.raises(ValueError):
        memory.reject("nothing")


def test_search_surface(memory):
    found = memory.search_memory("ada", 5, 1, 2).collect()
    assert [(r.kind, r.id) for r in found] == [("node", "a"), ("node", "b")]
    lines = {r.id: (r.path, r.summary) for r in memory.deep_search("ada").collect()}
    assert lines["a"] == ("nodes/a.md", "person: ada — city: ada") and lines["a|same_as|b"][1] == "a —[same_as]→ b"
    assert {(r.kind, r.type, r.n) for r in memory.dashboard().collect()} == {("node", "person", 2), ("edge", "same_as", 1), ("edge", "related_to", 1)}


def test_ingest_surface(spark, memory, tmp_path):
    docs = spark.createDataFrame([("u", "https://a.b", "latent", None, None), ("v", "https://c.d", "web", "t", "x")], "user_id string, source_uri string, source_type string, title string, content string")

    def fetch(url):
        if "down" in url:
            raise OSError("down")
        return "<html><head><title>T</title></head><body><p>Hello</p></body></html>"

    out, bad = memory.ingest_urls(docs, ["https://a.b", "ftp://x", "https://down.e"], fetch)
    assert {(r.source_uri, r.outcome, r.title) for r in out.collect()} == {("https://a.b", "replaced", "T")}
    assert {r.url for r in bad.collect()} == {"ftp://x", "https://down.e"}
    (tmp_path / "n.md").write_text("# note")
    assert {r.outcome for r in memory.ingest_files(docs, str(tmp_path)).collect()} == {"kept", "inserted"}
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "bot", None)], "conv_id long, turn int, role string, text string")
    assert [r.content for r in memory.ingest_conversations(docs, turns).where("outcome = 'inserted'").collect()] == ["user: hi\nbot: "]


def test_resolve_user(spark):
    users = spark.createDataFrame([("u", "ann"), ("v", "bob")], "user_id string, identifier string")
    assert resolve_user(users, "v", "ann", "u") == "v" and resolve_user(users, None, "ann", "v") == "u" and resolve_user(users, session_user="v") == "v"
    for args in ((), ("x",), (None, "zed", "u")):
        with pytest.raises(ValueError):
            resolve_user(users, *args)


def test_search_fields_of_nodes(spark):
    rows = [("1", "alpha", ["beta"], {"content": "gamma words", "aliases": "delta"}), ("2", "other", [], {"title": "gamma"}), ("3", "beta", [], None)]
    nodes = spark.createDataFrame([(i, "u", "object", n, a, p) for i, n, a, p in rows], "id string, user_id string, type string, name string, aliases array<string>, properties map<string,string>")
    edges = spark.createDataFrame([], "id string, user_id string, type string, source_node_id string, target_node_id string")
    memory = Memory("u", nodes, edges)
    found = {q: {r.id for r in memory.search(q).collect()} for q in ("alpha", "beta", "gamma", "delta", "?", "")}
    assert found == {"alpha": {"1"}, "beta": {"1", "3"}, "gamma": {"1"}, "delta": {"1"}, "?": set(), "": set()}
