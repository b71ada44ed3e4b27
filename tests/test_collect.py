"""Collection of typed sources, guards, search pages, and ranks over whole tables."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeeper.functions import web as W
from lorekeeper.operators import batching, dedup, ordering, search
from lorekeeper.sources import collect

SOURCES = "user_id string, type string, uri string, content string"


def test_routes_and_problems(spark):
    urls = ["https://www.youtube.com/watch?v=abcdefghijk", "https://youtu.be/abcdefghijk", "https://a.substack.com/p/x", "https://Blog.example/p", "https://other.example/", "ftp://x.example/", "", None, "https://m.youtube.com/feeds/videos.xml?channel_id=1"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    hosts = spark.createDataFrame([("www.blog.example",), ("blog.example",)], "host string")
    got = {r.url: (r.problem, r.handler) for r in collect.routed(rows, hosts).collect()}
    assert got == {
        urls[0]: (None, "youtube"), urls[1]: (None, "youtube"), urls[2]: (None, "substack"), urls[3]: (None, "substack"), urls[4]: (None, "web"),
        urls[5]: ("scheme", None), urls[6]: ("empty", None), None: ("empty", None), urls[8]: ("feed", None),
    }


def test_collect_keeps_going(spark):
    asked = []

    def fetch(url):
        asked.append(url)
        if "bad" in url:
            raise OSError("down")
        return "<title>T</title><article><p>words</p></article>"

    rows = [
        ("u", "url", "https://site.example/a", None), ("v", "url", "https://site.example/a", None), ("u", "url", "https://bad.example/", None), ("u", "conversation", "talk", "user: hi"), ("u", "file", "x.md", "text"),
        ("u", "file", "big.md", "x" * 400_001), ("u", "video", "y", None), ("u", "url", "https://youtu.be/short", None), ("u", None, "z", None),
    ]
    got = collect.collect(spark.createDataFrame(rows, SOURCES), fetch, F.lit("2000-01-01").cast("timestamp"))
    docs = {(r.user_id, r.source_type, r.content) for r in got.documents.collect()}
    assert docs == {("u", "web", "T\nwords"), ("v", "web", "T\nwords"), ("u", "conversation", "user: hi"), ("u", "file", "text")}
    fails = {(r.uri, r.error) for r in got.failures.collect()}
    assert fails == {("https://bad.example/", "OSError: down"), ("big.md", "payload"), ("y", "unknown_type"), ("https://youtu.be/short", "invalid_video"), ("z", "unknown_type")}


def test_dataset_rows_pass_through_a_failed_fetch(spark):
    def fetch(url):
        if url.endswith("/3"):
            raise OSError("down")
        return f"<p>paper {url[-1]}</p>"

    rows = spark.createDataFrame([(str(i), f"t{i}", "A", "abs", "2024-01-01") for i in range(8)], "id string, title string, authors string, abstract string, update_date string")
    got = {r.source_uri[-1]: (r.batch, r.content) for r in collect.ingest_dataset(rows, "id", F.current_timestamp(), 2, 4, 3, fetch).collect()}
    assert got == {"2": (0, "paper 2"), "3": (0, None), "4": (0, "paper 4"), "5": (1, "paper 5")}


def test_guards(spark):
    docs = spark.createDataFrame([("1", "u"), ("2", "v")], "doc_id string, user_id string")
    with pytest.raises(ValueError):
        collect.scoped(docs, ["1"])
    assert [r.doc_id for r in collect.scoped(docs, ["1", "2"], "u").collect()] == ["1"] and collect.scoped(docs).count() == 2
    results = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "rank int, url string")
    assert [r.url for r in collect.to_ingest(results, 2).collect()] == ["a", "b"] and collect.to_ingest(results).count() == 3
    assert [r.url for r in collect.to_ingest(results, 2, ["z"]).collect()] == ["z"]
    with pytest.raises(ValueError):
        dedup.ExtractionConfig(type_strict=True, same_type_only=False)
    assert dedup.ExtractionConfig(False, False).same_type_only is False


def test_search_pages_of_engines(spark):
    row = spark.range(1).select(
        W.engine_url(F.lit("a b&c"), "google", "us", "en", 20).alias("g"), W.engine_url(F.lit("x"), "google").alias("p"), W.engine_url(F.lit("x"), "bing", "de", "de", 10).alias("b"), W.engine_url(F.lit("x"), "yandex", "84").alias("y"),
        W.snippet(F.lit("<div><h3>Title</h3> <p>some words that tell more</p></div>"), F.lit("Title")).alias("s"), W.snippet(F.lit("<b>Title</b> short"), F.lit("Title")).alias("e"), W.snippet(F.lit("word " * 100), F.lit("")).alias("l"),
    ).first()
    assert row.g == "https://www.google.com/search?q=a+b%26c&gl=us&hl=en&start=20" and row.p == "https://www.google.com/search?q=x"
    assert row.b == "https://www.bing.com/search?q=x&cc=de&setLang=de&first=11" and row.y == "https://yandex.com/search/?text=x&lr=84"
    assert row.s == "some words that tell more" and row.e == "" and row.l == ("word " * 60).rstrip() + "..."
    with pytest.raises(ValueError):
        W.engine_url(F.lit("x"), "other")


def test_one_leg_that_fails_leaves_the_other(spark):
    good = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id long, score double")
    bad = spark.createDataFrame([(1,)], "other long")
    assert [r.id for r in search.hybrid_search(good, bad, 5).collect()] == [1, 2]
    assert [r.id for r in search.hybrid_search(None, good, 1).collect()] == [1]
    with pytest.raises(ValueError):
        search.hybrid_search(bad, None, 5)


def test_global_ranks_and_even_shards(spark):
    values = random.Random(3).sample(range(10_000), 700)
    df = spark.createDataFrame([(v, "x") for v in values], "k long, other string").repartition(7)
    got = {r.k: r["rank"] for r in ordering.global_rank(df, "k").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
    for shards in (1, 7, 699, 1000):
        counts = {}
        for r in batching.balanced_shards(df, shards, "k").collect():
            counts.setdefault(r["shard"], []).append(r.k)
        used = min(shards, len(values))
        assert [len(counts[i]) for i in range(used)] == [len(values) // used + (i < len(values) % used) for i in range(used)]
        assert [k for i in range(used) for k in sorted(counts[i])] == sorted(values)


def test_as_of_join(spark):
    left = spark.createDataFrame([("a", 1, "l1"), ("a", 5, "l2"), ("b", 3, "l3"), ("a", 2, "l4")], "k string, t int, name string")
    right = spark.createDataFrame([("a", 2, 10), ("a", 2, 11), ("a", 4, 20), ("a", 6, 30), ("b", 4, 40)], "k string, t int, v int")
    got = {r.name: r.v for r in ordering.as_of_join(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {"l1": None, "l2": 20, "l3": None, "l4": 11}
