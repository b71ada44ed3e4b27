"""The stages that take extracted rows into the graph's tables."""

import pytest
from pyspark.sql import functions as F

from lorekeeper.operators import dedup, ingestion

NODE = "id string, user_id string, type string, subtype string, name string, canonical_name string, aliases array<string>, sources array<string>, properties map<string,string>, confidence double, embedding array<double>, merged_into string, created_at timestamp, updated_at timestamp"
EDGE = "id string, user_id string, type string, semantic_type string, source_node_id string, source_type string, target_node_id string, target_type string, properties map<string,string>, sources array<string>, created_at timestamp, updated_at timestamp"
NEW_NODE = "user_id string, source_uri string, seq long, type string, subtype string, name string, properties map<string,string>, embedding array<double>"
NEW_EDGE = "user_id string, source_uri string, seq long, type string, semantic_type string, source_type string, source_name string, target_type string, target_name string, properties map<string,string>"


def now():
    return F.lit("2024-06-01").cast("timestamp")


def person(name, vector, properties=None, gone=None):
    return (f"u:person:{name}", "u", "person", "individual", name, name, [], ["old"], properties or {}, 1.0, vector, gone, None, None)


def said(seq, name, vector=None, properties=None, kind="person", subtype="individual"):
    return ("u", f"doc://{seq}", seq, kind, subtype, name, properties or {}, vector)


def knows(seq, a, b, properties=None):
    return ("u", f"doc://{seq}", seq, "related_to", "knows", "person", a, "person", b, properties or {})


def tables(spark, nodes=(), edges=(), new_nodes=(), new_edges=()):
    return [spark.createDataFrame(list(rows), schema) for rows, schema in ((nodes, NODE), (edges, EDGE), (new_nodes, NEW_NODE), (new_edges, NEW_EDGE))]


def by_id(df):
    rows = [r.asDict() for r in df.collect()]
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r for r in rows}


CONFIG = dedup.DedupConfig(merge=0.95, flag=0.8, fuzzy=1.0)


def test_merge_flag_and_insert(spark):
    current = [person("ann", [1.0, 0.0], {"role": "x"}), person("bob", [0.0, 1.0])]
    new = [said(1, "Annie", [1.0, 0.01], {"role": "engineer", "city": "Rome"}), said(2, "Robert", [0.5, 0.86]), said(3, "Zed", [-1.0, 0.0]), said(4, " ZED ", None, {"k": "late"})]
    links = [knows(1, "Annie", "Robert"), knows(2, "Annie", "ann"), knows(3, "Zed", "Annie", {"w": "1"}), knows(4, "zed", "annie", {"w": "2"})]
    nodes, edges, decided = ingestion.apply_writes(*tables(spark, current, [], new, links), now(), CONFIG)
    got = {r.id: (r.target_id, r.action) for r in decided.collect()}
    assert got == {"u:person:annie": ("u:person:ann", "merged"), "u:person:robert": ("u:person:robert", "flagged"), "u:person:zed": ("u:person:zed", "none")}
    n = by_id(nodes)
    assert set(n) == {"u:person:ann", "u:person:bob", "u:person:robert", "u:person:zed"}
    assert n["u:person:ann"]["aliases"] == ["Annie"] and n["u:person:ann"]["sources"] == ["doc://1", "old"]
    assert n["u:person:ann"]["properties"] == {"role": "engineer", "city": "Rome"}
    assert n["u:person:zed"]["sources"] == ["doc://3", "doc://4"] and n["u:person:zed"]["properties"] == {"k": "late"}
    e = by_id(edges)
    plain = {k for k in e if "|related_to|" in k}
    assert plain == {"u:person:ann|related_to|u:person:robert", "u:person:zed|related_to|u:person:ann"}
    assert e["u:person:zed|related_to|u:person:ann"]["properties"] == {"w": "2"} and e["u:person:zed|related_to|u:person:ann"]["sources"] == ["doc://3", "doc://4"]
    pending = e["u:person:robert|same_as|u:person:bob"]
    assert pending["properties"]["status"] == "pending" and pending["properties"]["match_type"] == "embedding"
    assert "u:document:doc://1|mentions|u:person:ann" in e and len(e) == 2 + 1 + 4


def test_a_second_run_changes_nothing_and_reviews_stay(spark):
    current = [person("bob", [0.0, 1.0])]
    inputs = tables(spark, current, [], [said(2, "Robert", [0.5, 0.86])], [knows(2, "Robert", "Bob")])
    nodes, edges, _ = ingestion.apply_writes(*inputs, now(), CONFIG)
    once = by_id(nodes), by_id(edges)
    nodes, edges = spark.createDataFrame(nodes.collect(), NODE), spark.createDataFrame(edges.collect(), EDGE)
    again = ingestion.apply_writes(nodes, edges, *inputs[2:], now(), CONFIG)
    assert (by_id(again[0]), by_id(again[1])) == once
    confirmed = edges.withColumn("properties", F.when(F.col("type") == "same_as", F.map_concat(F.map_filter("properties", lambda k, _: k != "status"), F.create_map(F.lit("status"), F.lit("confirmed")))).otherwise(F.col("properties")))
    after = by_id(ingestion.apply_writes(nodes, spark.createDataFrame(confirmed.collect(), EDGE), *inputs[2:], now(), CONFIG)[1])
    assert after["u:person:robert|same_as|u:person:bob"]["properties"]["status"] == "confirmed"


def test_names_alike_merge_by_both_scores(spark):
    """The mean of cosine and name similarity decides where the names are alike."""
    config = dedup.DedupConfig(merge=0.95, flag=0.5, fuzzy=0.9)
    current = [person("jonathan smith", [0.8, 0.6])]
    _, _, decided = ingestion.apply_writes(*tables(spark, current, [], [said(1, "Jonathan  Smyth", [1.0, 0.0])], []), now(), config)
    row = decided.first()
    assert row.action == "flagged" and row.score == pytest.approx((0.8 + 2 * 13 / 28) / 2)


def test_empty_inputs(spark):
    nodes, edges, decided = ingestion.apply_writes(*tables(spark, [person("bob", [0.0, 1.0])]), now(), CONFIG)
    assert nodes.count() == 1 and edges.count() == 0 and decided.count() == 0


def test_embedding_and_plain_upsert(spark):
    inputs = tables(spark, [], [], [said(1, "Ann", None, {"role": "x"})], [])
    nodes, _, _ = ingestion.apply_writes(*inputs, now(), embed=lambda texts: [[float(len(t)), 0.0] for t in texts])
    assert nodes.first().embedding == [float(len("person: Ann\nrole: x")), 0.0]
    with pytest.raises(ValueError):
        ingestion.apply_writes(*inputs, now(), CONFIG, strategy="other")


def test_extract_and_validate(spark):
    def model(text):
        if text == "bad":
            raise RuntimeError("no answer")
        return [{"type": "person", "subtype": "individual", "name": text, "properties": {"role": "x", "odd": 1}}, {"type": "alien", "name": "e"}], [{"type": "related_to", "semantic_type": "knows", "source_type": "person", "source_name": text, "target_type": "person", "target_name": ""}]

    chunks = spark.createDataFrame([("u", "doc://1", 1, "Ann"), ("u", "doc://2", 2, "bad"), ("u", "doc://3", 3, None)], "user_id string, source_uri string, seq long, text string")
    rows = ingestion.extract(chunks, model)
    assert {(r.source_uri, r.kind, r.name) for r in rows.where("kind = 'failed'").collect()} == {("doc://2", "failed", "no answer")}
    found = ingestion.validate(rows.where("kind = 'node'"), rows.where("kind = 'edge'"), {"person": ["role"]})
    assert [(r.name, r.properties) for r in found.nodes.collect()] == [("ann", {"role": "x"})]
    assert found.edges.count() == 0
    reasons = sorted((r.kind, r.seq, r.reason) for r in found.rejected.collect())
    assert reasons == [("edge", 1, "missing_endpoint_name"), ("edge", 3, "missing_endpoint_name"), ("node", 1, "unknown_type"), ("node", 3, "missing_name"), ("node", 3, "unknown_type")]
    assert [(r.field, r.value) for r in found.dropped.where("id = 'u:person:ann'").collect()] == [("odd", "1")]


def talk(text):
    """A model that reads ``kind name key=value`` and ``a knows b`` lines."""
    nodes, edges = [], []
    for line in text.split(";"):
        words = line.split()
        if "fail" in words:
            raise RuntimeError("no answer")
        if len(words) == 3 and words[1] == "knows":
            edges.append({"type": "related_to", "semantic_type": "knows", "source_type": "person", "source_name": words[0], "target_type": "person", "target_name": words[2], "properties": {"since": "1999", "role": "x"}})
        elif words and words[0] == "person":
            nodes.append({"type": "person", "subtype": "individual", "name": words[1], "properties": dict(w.split("=") for w in words[2:])})
        elif words and words[0] == "likes":
            nodes.append({"type": "preference", "name": "p", "properties": {"statement": "Likes " + words[1], "category": words[2]}})
    return nodes, edges


DOCS = [
    ("u", "doc://1", "person Ann email=a@b shoe=42 ; person Me occupation=cook ; Me knows Ann"),
    ("u", "doc://2", "likes Tea food ; likes Rain weather ; person ann nationality=it"),
    ("u", "doc://3", "fail"),
    ("v", "doc://1", "person Me"),
    ("u", "doc://4", "   "),
    ("u", "doc://5", None),
]


def test_ingest_documents(spark):
    docs = spark.createDataFrame(DOCS, "user_id string, source_uri string, content string")
    users = spark.createDataFrame([("u", ["me", "i"]), ("v", ["nobody", ""])], "user_id string, known array<string>")
    nodes, edges, *_ = tables(spark)
    got = ingestion.ingest_documents(docs, nodes, edges, talk, now(), users)
    n, e = by_id(got.nodes), by_id(got.edges)
    people = {k: v for k, v in n.items() if v["type"] == "person"}
    assert set(people) == {"u:person:ann", "u:person:self", "v:person:me"}
    assert people["u:person:ann"]["properties"] == {"email": "a@b", "nationality": "it"} and people["u:person:ann"]["sources"] == ["doc://1", "doc://2"]
    assert people["u:person:self"]["aliases"] == ["me"] and people["u:person:self"]["properties"] == {"occupation": "cook"}
    assert {k for k, v in n.items() if v["type"] == "preference"} == {"u:preference:likes-tea", "u:preference:likes-rain"}
    assert "category" not in n["u:preference:likes-rain"]["properties"]
    assert {k for k in n if n[k]["type"] == "chunk"} == {"u:chunk:doc://1#chunk-0", "u:chunk:doc://2#chunk-0", "u:chunk:doc://3#chunk-0", "v:chunk:doc://1#chunk-0"}
    assert {k for k in e if "|has|" in k} == {"u:person:self|has|u:preference:likes-tea", "u:person:self|has|u:preference:likes-rain"}
    assert e["u:person:self|related_to|u:person:ann"]["semantic_type"] == "knows"
    assert "u:chunk:doc://1#chunk-0|part_of|u:document:doc://1" in e and "u:document:doc://1|mentions|u:person:self" in e
    drops = {(r.kind, r.field, r.reason) for r in got.dropped.collect()}
    assert drops == {("node", "shoe", "unknown_field"), ("node", "category", "invalid_value"), ("edge", "since", "unknown_field"), ("edge", "role", "unknown_field")}
    assert [(r.source_uri, r.error) for r in got.failed.collect()] == [("doc://3", "no answer")]
    again = ingestion.ingest_documents(docs, got.nodes, got.edges, talk, now(), users)
    assert by_id(again.nodes) == n and by_id(again.edges) == e


def test_chunks_of_an_encoder(spark):
    from lorekeeper.operators.chunking import chunk_texts

    docs = spark.createDataFrame([("a", "abcdefghij"), ("b", ""), ("c", None), ("d", "xy")], "k string, text string")
    rows = chunk_texts(docs, ["k"], "text", 4, 1, lambda t: [ord(c) for c in t], lambda ts: "".join(map(chr, ts))).collect()
    assert sorted((r.k, r.chunk_index, r.text) for r in rows) == [("a", 0, "abcd"), ("a", 1, "defg"), ("a", 2, "ghij"), ("a", 3, "j"), ("d", 0, "xy")]
    with pytest.raises(ValueError):
        chunk_texts(docs, ["k"], encode=lambda t: [])
