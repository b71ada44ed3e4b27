import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeeper.functions import similarity, text, web
from lorekeeper.functions.ontology import Ontology
from lorekeeper.operators import batching, dedup, filters, pipeline, resolution, search, supersession, traversal, validation, writes
from lorekeeper.plans import graph
from lorekeeper.sources import documents
from lorekeeper.streaming import events as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_indel_ratio():
    for a, b in [("", ""), ("a", ""), ("kitten", "sitting"), ("abcbdab", "bdcaba"), ("é😀x", "x😀é"), ("aaaa", "aa"), ("night", "nacht")]:
        assert similarity.lcs_length(a, b) == lcs(a, b)
        n = len(a) + len(b)
        assert similarity.indel_ratio(a, b) == (2 * lcs(a, b) / n if n else 1.0)
    assert similarity.indel_ratio(None, "a") == 0.0


def test_token_sort_ratio(spark):
    df = spark.createDataFrame([("Smith  John", "John Smith"), ("a b", "c d")], "a string, b string")
    assert [r[0] for r in df.select(similarity.token_sort_ratio(F.col("a"), F.col("b"))).collect()] == [1.0, pytest.approx(similarity.indel_ratio("a b", "c d"))]


def test_cosine_edges(spark):
    z, u, v = (F.array(*[F.lit(float(x)) for x in xs]) for xs in ([0, 0], [1, 0], [-1, 0]))
    assert one(spark, similarity.cosine(z, u)) == 0 and one(spark, similarity.cosine(u, v)) == -1
    assert one(spark, similarity.cosine_clamped(u, v)) == 0 and one(spark, similarity.raw_cosine(F.lit(1.2))) == 1


@pytest.mark.parametrize(
    ("raw", "slug"),
    [("Prefers DARK Mode for editors", "prefers-dark-mode-for-editors"), ("I really love café !!", "i-really-love-cafe"), ("   ", ""), ("word " * 30, ("word-" * 16)[:-1][:79]), ("x" * 100, "x" * 80)],
)
def test_slugify(spark, raw, slug):
    assert one(spark, text.slugify(F.lit(raw))) == slug


def test_text_functions(spark):
    assert one(spark, text.normalize_name(F.lit("  Ada \t LOVELACE "))) == "ada lovelace"
    assert one(spark, text.truncate(F.lit("abcdefgh"), 6)) == "abc..." and one(spark, text.truncate(F.lit("abc"), 6)) == "abc"
    assert one(spark, text.sanitize(F.lit("a\x00b\tc\x7f\n"))) == "ab\tc\n"
    assert [one(spark, text.token_estimate(F.lit(t))) for t in ("", "ab", "abcdef")] == [0, 1, 3]
    assert one(spark, text.display_name(F.lit(None).cast("string"), F.lit("u:person:ann:b"))) == "ann:b"
    props = F.create_map(*[F.lit(x) for x in ("team", "memory", "role", "engineer", "content", "long")])
    assert one(spark, text.embedding_text(F.lit("person"), F.lit("Bob"), props)) == "person: Bob\nrole: engineer\nteam: memory\nlong"
    assert one(spark, F.length(text.file_slug(F.lit("y" * 200)))) == 120
    assert one(spark, text.truncate_bytes(F.lit("abcdef"), 3)) == "abc...[truncated]"


def test_web_functions(spark):
    assert one(spark, web.host(F.lit("HTTPS://www.Example.com:80/x"))) == "example.com"
    assert one(spark, web.source_type(F.lit("https://x.substack.com/p/1"))) == "substack"
    assert one(spark, web.source_type(F.lit("https://huggingface.co/datasets/a"))) == "huggingface"
    assert [one(spark, web.url_problem(F.lit(u))) for u in ("", "ftp://a", "https://", "https://a.b")] == ["empty", "scheme", "host", None]
    assert one(spark, web.markdown_title(F.lit("x\n # Big  Title \ny"), F.lit("https://a/b"))) == "Big  Title"
    assert one(spark, web.markdown_title(F.lit("x"), F.lit("https://a.b/some-page.html"))) == "Some Page"
    assert one(spark, web.authors(F.lit("Ann,  Bob ,"))) == ["Ann", "Bob"]
    assert str(one(spark, web.parse_date(F.lit("Tue, 02 Jan 2024 03:04:05 GMT"), F.lit(None)))) == "2024-01-02 03:04:05"
    assert one(spark, web.seconds(F.lit("1500"))) == 1.5 and one(spark, web.seconds(F.lit("x"))) == 0
    assert one(spark, web.html_text(F.lit("<p>a<br>b</p><script>x</script><div> c <b>d</b></div>"))) == "a\nb\nc d"
    assert one(spark, web.meta(F.lit('<meta name="author" content="Ann">'), "author")) == "Ann"
    assert one(spark, web.is_organic(F.lit("https://maps.google.com/x"))) is False and one(spark, web.is_organic(F.lit("https://a.b"))) is True
    assert one(spark, web.is_organic(F.lit("https://www.youtube.com/watch?v=abcdefghijk"))) is True and one(spark, web.is_organic(F.lit("https://www.youtube.com/redirect?q=x"))) is False


def test_ontology(spark):
    o = Ontology()
    o.register_node_type("gadget", ("small",))
    o.register_node_type("gadget", ("small",))
    with pytest.raises(ValueError):
        o.register_node_type("gadget", ("large",))
    o.register_relation_semantic("holds", (("person", "gadget"),))
    assert ("person", "gadget") in o.edges["related_to"][0]
    assert Ontology().schema() == Ontology().schema() and len(Ontology().semantics) == 16
    assert Ontology().edge_pairs(spark).where("type = 'same_as' and source_type = 'fact'").count() == 0


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "w " * 500), (2, ""), (3, None), (4, "a b c")], "doc_id long, text string")
    assert {(r.doc_id, r.n) for r in graph.chunks(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {(1, 2), (4, 1)}
    assert [r.text for r in graph.chunks(docs.where("doc_id = 4"), 2, 1).orderBy("chunk_index").collect()] == ["a b", "b c", "c"]
    with pytest.raises(ValueError):
        graph.chunks(docs, 4, 4)


def test_first_needs_an_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    with pytest.raises(pipeline.PipelineError, match="sort"):
        pipeline.run_pipeline(df, [{"$group": {"_id": None, "x": {"$first": "$name"}}}])
    rows = pipeline.run_pipeline(df, [{"$sort": {"id": -1}}, {"$group": {"_id": None, "x": {"$first": "$name"}, "y": {"$last": "$name"}}}]).collect()
    assert [(r.x, r.y) for r in rows] == [("b", "a")]
    assert pipeline.run_pipeline(df, [{"$match": {"gone": None}}]).count() == 2 and pipeline.run_pipeline(df, [{"$match": {"gone": 1}}]).count() == 0


def test_lookup_of_each_root_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "a"), ("e3", "b", "c")], "id string, source_node_id string, target_node_id string")
    seeds = spark.createDataFrame([("a",), ("c",), (None,), ("a",)], "id string")
    got = sorted((r.root, r.id, r.depth) for r in traversal.graph_lookup_each(edges, seeds, 4).collect())
    assert got == [("a", "e1", 0), ("a", "e2", 1), ("a", "e3", 1)]


def test_surfaces_are_normalised(spark):
    df = spark.createDataFrame([(" Ada \t Lovelace", "ADA lovelace", ["Countess ", None, ""])], "name string, canonical_name string, aliases array<string>")
    assert df.select(dedup.surfaces().alias("x")).first().x == ["ada lovelace", "countess"]


def test_tenant_lock(spark):
    nodes = spark.createDataFrame([("a", "u1", "person", "x"), ("b", "u2", "person", "x")], "id string, user_id string, type string, name string")
    q = filters.GraphQuery("u1", nodes, nodes)
    assert [r.id for r in q.find_nodes("person", where={"user_id": "u2", "name": "x"}).collect()] == ["a"]
    with pytest.raises(ValueError):
        q.find_nodes(where={"type": "event"})
    with pytest.raises(ValueError):
        filters.GraphQuery(None, nodes, nodes)


def test_pipeline_rules():
    with pytest.raises(pipeline.PipelineError, match="allowed are"):
        pipeline.validate([{"$lookup": {}}])
    with pytest.raises(pipeline.PipelineError):
        pipeline.validate([{"$match": {}}, {"$vectorSearch": {}}])
    assert pipeline.validate([{"$match": {}}], 7)[-1] == {"$limit": 7} and pipeline.validate([{"$limit": 900}], 7) == [{"$limit": 7}]
    assert pipeline.for_tenant([{"$group": {}}], "u")[0] == {"$match": {"user_id": "u"}}
    assert pipeline.for_tenant([{"$match": {"user_id": "x", "a": 1}}], "u") == [{"$match": {"a": 1, "user_id": "u"}}]
    assert pipeline.for_tenant([{"$vectorSearch": {"filter": {"user_id": "x"}}}], "u")[0]["$vectorSearch"]["filter"] == {"user_id": "u"}
    assert pipeline.with_embedding([{"$vectorSearch": {"queryVector": "__EMBED__", "queryText": "q"}}], lambda t: [1.0]) == [{"$vectorSearch": {"queryVector": [1.0]}}]


def test_pipeline_stages(spark):
    df = spark.createDataFrame([(1, None, ["a"]), (2, "x", []), (3, "y", ["b", "c"])], "id int, k string, tags array<string>")
    run = lambda *s: pipeline.run_pipeline(df, list(s), None, None)
    assert [r.id for r in run({"$match": {"k": None}}).collect()] == [1]
    assert [r.id for r in run({"$match": {"$nor": [{"k": "x"}], "id": {"$not": {"$gt": 2}}}}).collect()] == [1]
    assert [r.id for r in run({"$sort": {"k": 1}}).collect()] == [1, 2, 3]
    assert run({"$match": {"id": 9}}, {"$count": "n"}).count() == 0
    assert sorted(r.tags for r in run({"$unwind": "$tags"}).collect()) == ["a", "b", "c"]
    assert run({"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True}}).count() == 4
    assert run({"$sample": {"size": 2}}).count() == 2
    with pytest.raises(Exception, match="no bucket"):
        run({"$bucket": {"groupBy": "$id", "boundaries": [1, 2]}}).collect()
    calls = []

    def translate(question, problem):
        calls.append(problem)
        return [{"$bad": 1}] if problem is None else [{"$match": {"id": 2}}]

    assert pipeline.ask("?", translate, lambda s: pipeline.run_pipeline(df, s)).count() == 1 and len(calls) == 2


def test_rrf_of_a_shared_hit(spark):
    hits = spark.createDataFrame([("a", 0)], "id string, rank int")
    assert search.rrf([hits, hits], 10).first().score == pytest.approx(2 / 11)
    assert search.hybrid_search(None, spark.createDataFrame([("a", 1.0)], "id string, score double"), 5).count() == 1


def test_walks_end_on_cycles(spark):
    e = spark.createDataFrame([("1", "a", "b", "t"), ("2", "b", "c", "t"), ("3", "c", "a", "t"), ("4", "x", "b", "t")], "id string, source_node_id string, target_node_id string, type string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.depth) for r in traversal.graph_lookup(e, seeds, 9).collect()} == {("1", 0), ("2", 1), ("3", 2)}
    assert {(r.id, r.hops) for r in traversal.find_neighbors(e, "a", 2).collect()} == {("b", 1), ("c", 1), ("x", 2)}
    assert {r.id for r in traversal.same_as_cluster(e.withColumn("type", F.lit("same_as")), "b").collect()} == {"a", "b", "c", "x"}


def test_fuzzy_resolution_by_hand(spark):
    cands = resolution.live_candidates(spark.createDataFrame([("c1", "u", "t", "blue bolt", ["bb"]), ("c2", "u", "t", "blue belt", []), ("c3", "v", "t", "blue bolts", [])], "id string, user_id string, type string, name string, aliases array<string>"))
    mentions = spark.createDataFrame([("m1", "u", "t", "BOLT  blue"), ("m2", "u", "t", "blue blt"), ("m3", "u", "x", "blue bolt"), ("m4", "u", "t", "bb")], "mention_id string, user_id string, type string, name string")
    got = {r.mention_id: (r.matched_id, r.match_type, round(r.confidence, 4)) for r in resolution.resolve(mentions, cands).collect()}
    assert got == {"m1": ("c1", "fuzzy", 1.0), "m2": ("c2", "fuzzy", round(similarity.indel_ratio("blt blue", "belt blue"), 4)), "m3": (None, "none", 0.0), "m4": ("c1", "alias", 1.0)}


def test_resolution_has_no_cap(spark):
    nodes = spark.range(1500).select(F.lit("u").alias("user_id"), F.lit("t").alias("type"), F.format_string("n%05d", "id").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("name"), F.array(F.format_string("alias %d", "id")).alias("aliases"))
    mentions = nodes.where("id >= 'n01400'").select(F.concat("id", F.lit("e")).alias("mention_id"), "user_id", "type", F.upper("name").alias("name"))
    mentions = mentions.unionByName(nodes.where("id >= 'n01400'").select(F.concat("id", F.lit("a")).alias("mention_id"), "user_id", "type", F.col("aliases")[0].alias("name")))
    mentions = mentions.unionByName(nodes.where("id = 'n01499'").select(F.concat("id", F.lit("f")).alias("mention_id"), "user_id", "type", F.expr("substring(name, 2, 99)").alias("name")))
    got = {r.mention_id: (r.matched_id, r.match_type) for r in resolution.resolve(mentions, resolution.live_candidates(nodes)).collect()}
    assert got == {f"n{i:05}{k}": (f"n{i:05}", m) for i in range(1400, 1500) for k, m in (("e", "exact"), ("a", "alias"))} | {"n01499f": ("n01499", "fuzzy")}


def test_review_states(spark):
    e = spark.createDataFrame([("e1", {"status": "pending"}), ("e2", {"status": "rejected"})], "id string, properties map<string,string>")
    assert dedup.set_review(e, "e1", "confirmed").where("properties['status'] = 'confirmed'").count() == 1
    assert dedup.set_review(e, "e2", "rejected").count() == 2
    with pytest.raises(Exception, match="otherwise"):
        dedup.set_review(e, "e2", "confirmed").collect()
    with pytest.raises(ValueError):
        dedup.DedupConfig(merge=0.8, flag=0.9)


def test_judge(spark):
    old = spark.createDataFrame([("o1", "u", "a", None, datetime(2024, 1, 1)), ("o2", "u", "b", None, datetime(2024, 1, 2))], "id string, user_id string, statement string, created_at timestamp, valid_from timestamp")
    new = old.where("id = 'o2'").withColumn("id", F.lit("n"))

    def judge(before, after):
        if before["id"] == "o2":
            raise RuntimeError
        return True, 3.0

    assert [tuple(r) for r in supersession.supersede_by_judge(new, old, ["user_id"], judge).collect()] == [("n", "o1", 1.0)]


def test_batching(spark):
    sizes = [len(list(g)) for g in (spark.range(7).coalesce(1).transform(lambda d: batching.balanced_shards(d, 3, "id")).groupBy("shard").agg(F.collect_list("id").alias("x")).orderBy("shard").select("x").toPandas().x)]
    assert sizes == [3, 2, 2]
    rows = spark.createDataFrame([("a", "1"), ("b", "x")], "k string, v string")
    got = {r.k: (r.result, r.error) for r in batching.isolated_map(rows, "k", "v", lambda v: str(int(v) + 1)).collect()}
    assert got["a"] == ("2", None) and got["b"][0] is None and got["b"][1].startswith("ValueError")

    def embed(texts):
        if "bad" in texts:
            raise ValueError
        return [[1.0]] * len(texts)

    assert batching.embed_resilient(["a", "bad", "c"], embed) == [[1.0], [], [1.0]]
    nodes = spark.createDataFrame([("1", "a", None), ("2", "bad", []), ("3", "c", [9.0])], "id string, text string, embedding array<float>")
    assert {r.id: r.embedding for r in batching.embed_missing(nodes, embed).collect()} == {"1": [1.0], "2": [], "3": [9.0]}
    assert batching.assert_dimension(nodes, 1).count() == 3
    with pytest.raises(Exception, match="has not 2"):
        batching.assert_dimension(nodes, 2).collect()


def test_watermark_and_validation(spark):
    states = spark.createDataFrame([("u", "j", datetime(2024, 1, 1))], "user_id string, job string, last_run_at timestamp")
    assert writes.watermark(states, "u", "k").first()[0].year == 1970
    rows = spark.createDataFrame([("1", "person", {"role": "x", "age": "3"})], "id string, type string, properties map<string,string>")
    kept, dropped = validation.split_fields(rows, {"person": ["role"]})
    assert kept.first().properties == {"role": "x"} and [r.field for r in dropped.collect()] == ["age"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# hi")
    (tmp_path / "b.html").write_text("<p>x</p>")
    (tmp_path / "c.bin").write_text("no")
    assert {r.title: r.content for r in documents.file_documents(spark, str(tmp_path)).collect()} == {"a.md": "# hi", "b.html": "x"}
    got = documents.scrape(spark.createDataFrame([("u1",), ("u2",)], "url string"), lambda u: {"u1": "text"}[u], 2)
    assert {r.url: (r.success, r.content) for r in got.collect()} == {"u1": (True, "te"), "u2": (False, None)}
    urls = spark.createDataFrame([("https://blog.me/p/1", "substack"), ("https://blog.me/p/2", None), ("https://youtu.be/abcdefghijk", None)], "url string, type string")
    assert {r.url: r.type for r in documents.typed_sources(urls).collect()}["https://blog.me/p/2"] == "substack"
    page = '<a href="https://a.b/1"><h3>One</h3></a><a href="https://www.google.com/x"><h3>Own</h3></a><a href="https://c.d"><h3>Two</h3></a>'
    found = documents.search_results(spark.createDataFrame([("q", 0, page)], "query string, page int, html string"), 5).orderBy("rank").collect()
    assert [(r.rank, r.url, r.title) for r in found] == [(1, "https://a.b/1", "One"), (2, "https://c.d", "Two")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=7 * i), i % 3, "click" if i % 2 else "view", float(i), "{}") for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = streams.windowed_counts(df.withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    stream = streams.windowed_counts(streams.event_stream(spark, str(tmp_path / "in")), late="1 day")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("counts").collect())) == sorted(map(str, batch))


def test_stream_upsert(spark, tmp_path):
    spark.createDataFrame([("u", "1", "web", "a")], "user_id string, source_uri string, source_type string, title string").write.parquet(str(tmp_path / "in"))
    state = {"t": spark.createDataFrame([("u", "1", "latent", "x"), ("u", "2", "web", "y")], "user_id string, source_uri string, source_type string, title string")}

    def write(df):
        state["t"] = spark.createDataFrame(df.drop("outcome").collect(), df.drop("outcome").schema)

    stream = spark.readStream.schema(state["t"].schema).parquet(str(tmp_path / "in"))
    streams.upsert_stream(stream, lambda: state["t"], write, writes.upsert_documents, str(tmp_path / "ck")).awaitTermination(120)
    assert {r.source_uri: r.title for r in state["t"].collect()} == {"1": "a", "2": "y"}


def test_confirm_and_sweep(spark):
    schema = "id string, name string, aliases array<string>, sources array<string>, confidence double, properties map<string,string>, created_at timestamp, merged_into string, merged_at timestamp"
    rows = [("a", "Ann", [], ["1"], 0.5, {"r": "x"}, datetime(2024, 1, 2), None, None), ("b", "Anne", ["An"], ["2"], 0.9, {"r": "longer", "s": "y"}, datetime(2024, 1, 1), None, None), ("c", "Bob", [], [], 0.1, {}, None, None, None)]
    nodes = spark.createDataFrame(rows, schema)
    edges = spark.createDataFrame([("a|has|c", "u", "has", None, "a", "person", "c", "object", {"k": "1"}), ("b|has|c", "u", "has", None, "b", "person", "c", "object", {"k": "2"}), ("a|knows|b", "u", "knows", None, "a", "person", "b", "person", {})], "id string, user_id string, type string, semantic_type string, source_node_id string, source_type string, target_node_id string, target_type string, properties map<string,string>")
    pairs = spark.createDataFrame([("a", "b")], "a_id string, b_id string")
    now = F.lit("2024-03-01").cast("timestamp")
    new_nodes, new_edges = dedup.confirm(nodes, edges, pairs, now)
    got = {r.id: r for r in new_nodes.collect()}
    assert got["a"].merged_into == "b" and got["b"].merged_into is None and got["c"].merged_into is None
    assert got["b"].aliases == ["An", "Ann"] and got["b"].sources == ["1", "2"] and got["b"].properties == {"r": "longer", "s": "y"}
    assert {r.id: r.properties for r in new_edges.collect()} == {"b|has|c": {"k": "2"}}
    again = dedup.confirm(spark.createDataFrame(new_nodes.collect(), new_nodes.schema), new_edges, pairs, now)[0]
    assert sorted(map(str, again.collect())) == sorted(map(str, new_nodes.collect()))
    swept = spark.createDataFrame([("a", "b", 0.9, "merged"), ("a", "c", 0.5, "flagged")], "low_id string, high_id string, score double, action string")
    merge, flag = dedup.sweep_writes(swept)
    assert merge.count() == 1 and [r.id for r in flag.collect()] == ["a|same_as|c"]


def test_sweep_without_cap(spark):
    from lorekeeper.plans import queries_maintenance, registry  # noqa: F401

    rows = [(f"n{i:02}", "u", f"t{i // 2}", "n", None, [], None, [1.0, i % 2 / 100], datetime(2024, 2, 1)) for i in range(40)]
    nodes = spark.createDataFrame(rows, "id string, user_id string, type string, name string, canonical_name string, aliases array<string>, merged_into string, embedding array<double>, updated_at timestamp")
    none = spark.createDataFrame([], "source_node_id string, target_node_id string")
    since = F.lit("2024-01-01").cast("timestamp")
    assert {(r.low_id, r.high_id) for r in dedup.sweep(nodes, none, since, max_pairs=None).collect()} == {(f"n{i:02}", f"n{i + 1:02}") for i in range(0, 40, 2)}
    assert dedup.sweep(nodes, none, since, max_pairs=3).count() == 3
    plan = registry.QUERIES["d35_consolidation_sweep"](spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan


def test_memory(spark):
    from lorekeeper.memory import Memory

    nodes = spark.createDataFrame([("a", "u", "person", "ada lovelace", ["countess"], [1.0, 0.0]), ("b", "u", "object", "engine", [], [0.0, 1.0]), ("c", "v", "person", "ada", [], [1.0, 0.0])], "id string, user_id string, type string, name string, aliases array<string>, embedding array<double>")
    edges = spark.createDataFrame([("a|uses|b", "u", "uses", "a", "b"), ("a|uses|z", "u", "uses", "a", "z")], "id string, user_id string, type string, source_node_id string, target_node_id string")
    m = Memory("u", nodes, edges, lambda q: [1.0, 0.0], lambda q, e: [{"$match": {"type": "person", "user_id": "v"}}])
    assert [r.id for r in m.query("who?").collect()] == ["a"]
    assert m.search("countess", 1).first().id == "a"
    found, links = m.search_and_expand("ada", 1)
    assert {r.id for r in found.collect()} == {"a", "b"} and links.count() == 2
    assert {r.type for r in m.payload()[0].where("id = 'z'").collect()} == {"unknown"}


def test_video_sources(spark):
    feed = spark.createDataFrame([("https://youtu.be/abcdefghijk", "t", "c", "2024-01-01T00:00:00Z"), ("https://a.b", "x", "y", None)], "link string, title string, author string, published string")
    assert [r.video_id for r in documents.video_metadata(feed).collect()] == ["abcdefghijk"]
    assert documents.embed_metadata(spark.createDataFrame([("v", '{"title": "T"'), ("w", '{"title": "T", "author_name": "A"}')], "video_id string, body string")).where("channel = 'A'").count() == 1
    assert documents.source_rows(spark, [{"uri": "u", "max": 3}]).first().options == {"max": "3"}


def test_search_for_many_queries_is_the_search_for_each(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(300)] + [(300, None), (301, []), (302, [0.0] * 5)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    queries = vectors.where("id % 100 = 0 and id < 300").withColumnRenamed("id", "query_id")
    got = {}
    for r in search.vector_search_all(vectors, queries, 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert set(got) == {0, 100, 200}
    for q, found in got.items():
        want = [(r.id, r.score) for r in search.vector_search(vectors, rows[q][1], 7).collect()]
        assert [(i, s) for _, i, s in sorted(found)] == want
    assert search.vector_search_all(vectors.where("false"), queries, 7).count() == 0
    assert search.vector_search_all(vectors, queries.where("false"), 7).count() == 0


def test_queries_are_cut_as_texts_are(spark):
    docs = spark.createDataFrame([(1, "a knowledge graph memory"), (2, "nothing here")], "id long, text string")
    assert [r.id for r in search.text_search(docs, "Knowledge-graph?", 5).collect()] == [1]
