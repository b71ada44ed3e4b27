"""Feeds, the markdown tree, table functions, sketches, and merges of chains."""

import itertools
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekeeper.functions.tables import register_table_functions
from lorekeeper.operators import dedup, sketches
from lorekeeper.sources import documents, feeds, markdown

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Site</title><link>https://site</link>
<item><title>One &amp; only</title><link>https://site/1</link><description>short</description><dc:creator>Ann</dc:creator><pubDate>2024-01-02T03:04:05Z</pubDate><content:encoded><![CDATA[<p>Full <b>text</b></p>]]></content:encoded></item>
<item><title>Broken</title><link>https://site/2</link><description><b>never closed</description></item>
<item><title>No link</title></item>
<item><title></title><link> https://site/3 </link><author>Bob</author></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Other</title>
<entry><title>Two</title><link rel="self" href="https://self"/><link rel="alternate" href="https://other/1"/><author><name>Cid</name></author><author><name>Dora</name></author><updated>2024-02-03T00:00:00Z</updated><summary>s</summary></entry></feed>"""


def test_read_feeds(spark, tmp_path):
    for name, text in (("a.xml", RSS), ("sub/b.xml", ATOM), ("c.xml", "<rss><channel></channel></rss>"), ("d.xml", "no markup")):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(text)
    entries, failed = feeds.read_feeds(spark, str(tmp_path))
    got = {r.link: r for r in entries.collect()}
    assert set(got) == {"https://site/1", "https://site/3", "https://other/1"}
    one = got["https://site/1"]
    assert (one.title, one.summary, one.author, one.content[0].value) == ("One & only", "short", "Ann", "<p>Full <b>text</b></p>") and one.feed.endswith("a.xml")
    assert got["https://site/3"].title is None and got["https://site/3"].author == "Bob" and got["https://site/3"].content == []
    assert got["https://other/1"].author == "Cid, Dora" and got["https://other/1"].published == "2024-02-03T00:00:00Z"
    assert sorted((r.error, "Broken" in r.raw) for r in failed.collect()) == [("malformed_entry", True), ("missing_link", False)]
    docs = {r.source_uri: r for r in documents.feed_documents(entries, F.lit("2000-01-01").cast("timestamp")).collect()}
    assert docs["https://site/1"].content == "Full text" and docs["https://other/1"].authors == ["Cid", "Dora"] and docs["https://site/3"].title == "Untitled"


def test_files_are_one_document_each(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\ntwo lines\n")
    (tmp_path / "b.bin").write_text("x")
    rows = documents.file_documents(spark, str(tmp_path)).collect()
    assert [(r.title, r.content) for r in rows] == [("a.md", "# Title\n\ntwo lines\n")]


PAGES = "kind string, id string, path string, summary string, content string"


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, fs in os.walk(root) for f in fs if not f.startswith(".")}


def test_markdown_tree_is_written_whole_or_not_at_all(spark, tmp_path):
    target = str(tmp_path / "tree")
    rows = [("node", f"n{i}", f"nodes/n{i}.md", f"s{i}", f"# n{i}") for i in range(20)] + [("edge", "a b", "edges/a_b.md", None, "# one"), ("edge", "a/b", "edges/a_b.md", "t", None)]
    markdown.write_markdown(spark.createDataFrame(rows, PAGES), f"file://{target}", buckets=4)
    found = tree(target)
    pages = {k: v for k, v in found.items() if not k.endswith("index.md")}
    assert len(pages) == 22 and sorted(pages.values()) == sorted([r[4] or "" for r in rows])
    assert sum(v.count("\n") for k, v in found.items() if k.endswith("/index.md")) == 22
    assert all(line in found for line in [x.split("](")[1].rstrip(")") for x in found["index.md"].splitlines()])

    def fails(text):
        raise RuntimeError("no")

    bad = spark.createDataFrame(rows, PAGES).withColumn("content", F.udf(fails)("content"))
    with pytest.raises(Exception, match="no"):
        markdown.write_markdown(bad, f"file://{target}", buckets=4)
    assert tree(target) == found and os.listdir(tmp_path) == ["tree"]
    markdown.write_markdown(spark.createDataFrame(rows[:3], PAGES), f"file://{target}", buckets=4)
    assert len([k for k in tree(target) if not k.endswith("index.md")]) == 3 and os.listdir(tmp_path) == ["tree"]


def test_table_functions(spark):
    register_table_functions(spark)
    spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None)], "doc_id long, text string").createOrReplaceTempView("some_texts")
    rows = spark.sql("SELECT * FROM text_chunks(TABLE(some_texts), 3, 1)").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "a b c"), (1, 1, "c d e"), (1, 2, "e")]
    spark.createDataFrame([(q, i, float(i % 5)) for q in range(3) for i in range(q * 4)], "query_id long, id long, score double").createOrReplaceTempView("some_scores")
    rows = spark.sql("SELECT * FROM best_rows(TABLE(some_scores) PARTITION BY query_id ORDER BY (score DESC, id), 2)").collect()
    assert sorted(map(tuple, rows)) == [(1, 1, 3, 3.0), (1, 2, 2, 2.0), (2, 1, 4, 4.0), (2, 2, 3, 3.0)]


def test_sketches_merge_within_their_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("run"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), (F.xxhash64("id") % 20_000).alias("key"), F.rand(3).alias("value"))
    runs = sketches.run_sketches(rows, ["run", "kind"], "key", F.col("value"))
    got = {r.kind: r for r in sketches.estimates(sketches.merge_sketches(runs, ["kind"])).collect()}
    exact = {r.kind: r for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys")).collect()}
    for kind, r in got.items():
        assert r.n == exact[kind].n and abs(r.n_distinct - exact[kind].keys) <= sketches.COUNT_ERROR * exact[kind].keys
        values = sorted(x.value for x in rows.where(F.col("kind") == kind).select("value").collect())
        for q in (0.5, 0.9, 0.99):
            rank = sum(v <= r[f"q{round(q * 100)}"] for v in values) / len(values)
            assert abs(rank - q) <= sketches.RANK_ERROR


NODES = "id string, name string, aliases array<string>, sources array<string>, confidence double, properties map<string,string>, created_at timestamp, merged_into string, merged_at timestamp"
EDGES = "id string, user_id string, type string, semantic_type string, source_node_id string, source_type string, target_node_id string, target_type string, properties map<string,string>"


def test_chains_of_confirmed_pairs_in_any_order(spark):
    day = lambda d: datetime(2024, 1, d)
    rows = [
        ("a", "Ann", ["A"], ["1"], 0.5, {"r": "x"}, day(4), None, None),
        ("b", "Anne", [], ["2"], 0.9, {"r": "longer", "s": "y"}, day(3), None, None),
        ("c", "Anna", ["An"], ["3"], 0.1, {"s": "zz", "t": "c"}, day(2), None, None),
        ("d", "Anny", [], ["4"], 0.2, {"t": "d"}, day(1), None, None),
        ("e", "Eve", [], [], 0.2, {}, None, None, None),
        ("f", "Eva", [], [], 0.3, {}, day(1), None, None),
        ("g", "Gone", [], [], 0.3, {}, day(1), "e", None),
    ]
    nodes = spark.createDataFrame(rows, NODES)
    edges = spark.createDataFrame([(f"{s}|knows|{t}", "u", "knows", None, s, "person", t, "person", {"k": s}) for s, t in (("a", "e"), ("b", "e"), ("c", "d"), ("d", "e"))], EDGES)
    now = F.lit("2024-03-01").cast("timestamp")
    seen = set()
    for order in itertools.islice(itertools.permutations([("a", "b"), ("c", "b"), ("c", "d"), ("g", "f")]), 0, 24, 9):
        pairs = spark.createDataFrame(list(order), "a_id string, b_id string")
        new_nodes, new_edges = dedup.confirm(nodes, edges, pairs, now)
        table = (sorted(map(repr, new_nodes.collect())), sorted(map(repr, new_edges.collect())))
        seen.add(repr(table))
        got = {r.id: r for r in new_nodes.collect()}
        assert {i: r.merged_into for i, r in got.items()} == {"a": "d", "b": "d", "c": "d", "d": None, "e": "f", "f": None, "g": "e"}
        assert got["d"].aliases == ["A", "An", "Ann", "Anna", "Anne"] and got["d"].sources == ["1", "2", "3", "4"]
        assert got["d"].properties == {"r": "longer", "s": "zz", "t": "d"} and got["d"].confidence == 0.9
        assert {r.id for r in new_edges.collect()} == {"d|knows|f"}
    assert len(seen) == 1
    again = dedup.confirm(spark.createDataFrame(new_nodes.collect(), NODES), spark.createDataFrame(new_edges.collect(), EDGES), pairs, now)
    assert (sorted(map(repr, again[0].collect())), sorted(map(repr, again[1].collect()))) == table


def test_one_long_chain(spark):
    n = 200
    nodes = spark.createDataFrame([(f"{i:04}", "x", [], [], 0.5, {}, None, None, None) for i in range(n)], NODES)
    order = list(range(n - 1))
    random.Random(1).shuffle(order)
    pairs = spark.createDataFrame([(f"{i + 1:04}", f"{i:04}") for i in order], "a_id string, b_id string")
    out = dedup.confirm(nodes, spark.createDataFrame([], EDGES), pairs, F.current_timestamp())[0]
    assert [(r.merged_into, r["count"]) for r in out.groupBy("merged_into").count().orderBy("count").collect()] == [(None, 1), ("0000", n - 1)]
