"""Queries of sources, sinks, table functions, sketches and merges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import register_table_functions
from ..memory import deep_index
from ..operators import dedup, sketches
from ..sources import documents as D
from ..sources import collect, feeds, markdown
from ..storage import shared_folder
from . import graph as G
from .registry import query

KG = G.GRAPH_SQL


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey // 4 AS g, length(c_mktsegment) AS n, 'c' || lpad(c_custkey::VARCHAR, 9, '0') AS id, c_mktsegment AS seg FROM customer),
w AS (SELECT g, arg_min(id, (-n, id)) AS winner FROM c GROUP BY g)
SELECT id, CASE WHEN id <> winner THEN winner END AS merged_into, CASE WHEN id = winner THEN (SELECT count(*) FROM c o WHERE o.g = c.g) - 1 ELSE 0 END AS n_aliases FROM c JOIN w USING (g)""")
def d31_confirm_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers after chains of four were confirmed pair by pair in one call: the surest of each stays."""
    k = F.col("c_custkey")
    ident = lambda n: F.concat(F.lit("c"), F.lpad(n.cast("string"), 9, "0"))
    none = F.lit(None)
    nodes = G.table(spark, sf_dir, "customer").select(
        ident(k).alias("id"), F.col("c_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.array(F.lit("crm")).alias("sources"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("properties"),
        F.length("c_mktsegment").cast("double").alias("confidence"), none.cast("string").alias("merged_into"), none.cast("timestamp").alias("merged_at"), none.cast("timestamp").alias("created_at"),
    )
    keys = G.table(spark, sf_dir, "customer").select(k.alias("k"))
    pairs = keys.join(keys.select((F.col("k") - 1).alias("k"), F.col("k").alias("after")), "k").where("k div 4 = after div 4")
    pairs = pairs.select(F.when(F.col("k") % 2 == 0, ident(F.col("after"))).otherwise(ident(F.col("k"))).alias("a_id"), F.when(F.col("k") % 2 == 0, ident(F.col("k"))).otherwise(ident(F.col("after"))).alias("b_id"))
    edges = spark.createDataFrame([], "id string, user_id string, type string, semantic_type string, source_node_id string, source_type string, target_node_id string, target_type string, properties map<string,string>")
    return dedup.confirm(nodes, edges, pairs, F.lit("2024-06-01").cast("timestamp"))[0].select("id", "merged_into", F.size("aliases").cast("long").alias("n_aliases"))


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query("""SELECT page_id % 3 = 0 AS atom, url || '?p=' || page_id AS source_uri, 'Page & <' || page_id || '>' AS title, CASE WHEN page_id % 3 = 0 THEN ['Ann', 'Bo'] ELSE ['Cid'] END AS authors, TIMESTAMP '2024-02-03 04:05:06' AS published_at, 'A text of page ' || page_id || '.' AS content
FROM pages WHERE page_id % 10 <> 7 UNION ALL SELECT page_id % 3 = 0, NULL, 'malformed_entry', NULL, NULL, NULL FROM pages WHERE page_id % 10 = 7""")
def s1_feed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of RSS and Atom files that hold all pages, and a failure for each tenth, whose markup is broken."""
    p = G.table(spark, sf_dir, "pages").select("page_id", _escaped(F.concat("url", F.lit("?p="), "page_id")).alias("u"))
    title = _escaped(F.concat(F.lit("Page & <"), "page_id", F.lit(">")))
    body = F.concat(F.lit("&lt;p&gt;A text of page "), "page_id", F.lit(".&lt;/p&gt;"))
    broken = F.when(F.col("page_id") % 10 == 7, "<b>").otherwise("")
    when = F.lit("2024-02-03T04:05:06Z")
    rss = F.concat(F.lit("<item><title>"), title, F.lit("</title>"), broken, F.lit("<link>"), "u", F.lit("</link><dc:creator>Cid</dc:creator><pubDate>"), when, F.lit("</pubDate><content:encoded>"), body, F.lit("</content:encoded></item>"))
    atom = F.concat(
        F.lit("<entry><title>"), title, F.lit("</title>"), broken, F.lit('<link rel="self" href="https://self.example"/><link href="'), "u",
        F.lit('"/><author><name>Ann</name></author><author><name>Bo</name></author><updated>'), when, F.lit('</updated><content type="html">'), body, F.lit("</content></entry>"),
    )
    folder = f"{shared_folder(spark)}/feeds-{uuid.uuid4().hex}"
    p.select(F.when(F.col("page_id") % 3 == 0, atom).otherwise(rss).alias("value")).write.text(folder)
    entries, failed = feeds.read_feeds(spark, folder)
    docs = D.feed_documents(entries, F.lit("2000-01-01").cast("timestamp"))
    docs = docs.select(F.array_contains("authors", "Ann").alias("atom"), "source_uri", "title", "authors", "published_at", "content")
    gone = failed.select(F.col("raw").startswith("<entry").alias("atom"), F.col("error").alias("title"))
    return docs.unionByName(gone, allowMissingColumns=True)


@query(KG + "SELECT id, '# ' || name AS headline FROM nodes WHERE type IN ('location', 'organization')")
def s22_markdown_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and organizations written as a tree of markdown files and read back."""
    nodes = G.nodes(spark, sf_dir).where(F.col("type").isin("location", "organization"))
    index = deep_index(nodes, G.edges(spark, sf_dir).limit(0))
    folder = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    markdown.write_markdown(markdown.node_pages(nodes, index), folder)
    files = spark.read.text(f"{folder}/nodes/*/*.md", wholetext=True)
    files = files.where(F.element_at(F.split("_metadata.file_path", "/"), -1) != "index.md").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.split_part("value", F.lit("\n"), F.lit(1)).alias("headline"))
    ids = nodes.select("id", F.concat(T.file_slug(F.col("id")), F.lit(".md")).alias("file"))
    return files.join(ids, "file").select("id", "headline")


@query(KG + "SELECT doc_id, chunk_index, text FROM chunks")
def u1_chunk_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents by a table function in SQL."""
    register_table_functions(spark)
    G.table(spark, sf_dir, "documents").createOrReplaceTempView("lorekeeper_documents")
    return spark.sql("SELECT * FROM text_chunks(TABLE(SELECT doc_id, text FROM lorekeeper_documents), 512, 64)")


@query("SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank, o_orderkey AS id, o_totalprice::DOUBLE AS score FROM orders QUALIFY rank <= 3")
def u2_best_rows_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each customer by a table function over a partitioned table."""
    register_table_functions(spark)
    G.table(spark, sf_dir, "orders").createOrReplaceTempView("lorekeeper_orders")
    rows = "SELECT CAST(o_custkey AS BIGINT) AS query_id, CAST(o_orderkey AS BIGINT) AS id, CAST(o_totalprice AS DOUBLE) AS score FROM lorekeeper_orders"
    return spark.sql(f"SELECT * FROM best_rows(TABLE({rows}) PARTITION BY query_id ORDER BY (score DESC, id), 3)")


@query("""WITH e AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
SELECT event_type, n, users, true AS distinct_is_close, true AS median_is_close FROM e""")
def g11_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of events by type, merged from the sketches of each day, beside exact counts."""
    e = G.table(spark, sf_dir, "events").withColumn("run", F.to_date("ts"))
    runs = sketches.run_sketches(e, ["run", "event_type"], "user_id", F.col("value"))
    merged = sketches.estimates(sketches.merge_sketches(runs, ["event_type"]), (0.5,))
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.percentile("value", F.lit([0.5 - sketches.RANK_ERROR, 0.5 + sketches.RANK_ERROR])).alias("near"))
    both = merged.join(exact, "event_type")
    close = F.abs(F.col("n_distinct") - F.col("users")) <= F.ceil(sketches.COUNT_ERROR * F.col("users"))
    return both.select("event_type", "n", "users", close.alias("distinct_is_close"), F.col("q50").between(F.col("near")[0], F.col("near")[1]).alias("median_is_close"))


def _fetched(url: str) -> str:
    """A stand-in for the network: a page that says its url, none for every url that fails."""
    if "fails" in url:
        raise OSError("no answer")
    name = url.rsplit("/", 1)[-1]
    return f'<html><head><title>Page {name}</title></head><body><nav>menu</nav><article><p>Text of {name}.</p></article></body></html>'


@query("""WITH p AS (SELECT page_id AS i, 't' || page_id % 3 AS u, lpad((page_id % 1000)::VARCHAR, 3, '0') AS v FROM pages)
SELECT u AS user_id, CASE i % 6 WHEN 0 THEN 'https://site.example/' || i WHEN 2 THEN 'https://www.youtube.com/watch?v=abcdefgh' || v WHEN 4 THEN 'file:///' || i || '.md' ELSE 'https://news.substack.com/p/' || i END AS uri,
CASE i % 6 WHEN 0 THEN 'web' WHEN 2 THEN 'youtube' WHEN 4 THEN 'file' ELSE 'substack' END AS outcome, CASE i % 6 WHEN 0 THEN 'Page ' || i || 'menuText of ' || i || '.' WHEN 2 THEN 'said ' || v WHEN 4 THEN 'note ' || i ELSE 'Text of ' || i || '.' END AS content
FROM p WHERE i % 6 IN (0, 4, 5) OR i % 6 = 2 AND i % 4 = 0 GROUP BY ALL
UNION ALL SELECT u, CASE i % 6 WHEN 1 THEN 'https://site.example/fails/' || i WHEN 2 THEN 'https://youtu.be/abcdefgh' || v ELSE 'ftp://site.example/' || i END,
CASE i % 6 WHEN 1 THEN 'OSError: no answer' WHEN 2 THEN 'no_transcript' ELSE 'scheme' END, NULL FROM p WHERE i % 6 IN (1, 3) OR i % 6 = 2 AND i % 4 <> 0""")
def n16_collect_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of three families and files of all pages as documents of their tenants, and a failure for each that gives none."""
    i = F.col("page_id")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    v = F.lpad((i % 1000).cast("string"), 3, "0")
    forms = [text("https://site.example/", i), text("https://site.example/fails/", i), text("https://youtu.be/abcdefgh", v), text("ftp://site.example/", i), text("file:///", i, ".md"), text("https://news.substack.com/p/", i)]
    kind = F.when(i % 6 == 4, "file").otherwise("url")
    pages = G.table(spark, sf_dir, "pages").select("page_id")
    sources = pages.select(text("t", i % 3).alias("user_id"), kind.alias("type"), F.get(F.array(*forms), (i % 6).cast("int")).alias("uri"), F.when(i % 6 == 4, text("note ", i)).alias("content"))
    said = pages.where("page_id % 6 = 2 AND page_id % 4 = 0").select(text("abcdefgh", v).alias("video_id"), text("said ", v).alias("transcript")).distinct()
    got = collect.collect(sources, _fetched, F.lit("2000-01-01").cast("timestamp"), said)
    docs = got.documents.select("user_id", F.col("source_uri").alias("uri"), F.col("source_type").alias("outcome"), F.regexp_replace("content", "\n", "").alias("content"))
    return docs.unionByName(got.failures.select("user_id", "uri", F.col("error").alias("outcome"), F.lit(None).cast("string").alias("content")))


@query("""WITH c AS (SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, 9, '0') AS id FROM customer), p AS (SELECT k, id AS low, lpad((k + 1)::VARCHAR, 9, '0') AS high FROM c WHERE k % 3 = 1 AND k + 1 IN (SELECT k FROM c))
SELECT 'node' AS kind, id, CASE WHEN id IN (SELECT high FROM p WHERE k % 2 = 1) THEN 'merged' ELSE 'alive' END AS state FROM c
UNION ALL SELECT 'edge', low || '|same_as|' || high, 'pending' FROM p WHERE k % 2 = 0""")
def d36_apply_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers after a sweep that merges some neighbours and leaves others to a review; a dry run before it changes nothing."""
    k = F.col("c_custkey")
    ident = lambda n: F.lpad(n.cast("string"), 9, "0")
    none = F.lit(None)
    c = G.table(spark, sf_dir, "customer")
    nodes = c.select(
        ident(k).alias("id"), F.lit("t").alias("user_id"), F.lit("person").alias("type"), F.col("c_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.array(F.lit("crm")).alias("sources"),
        F.create_map().cast("map<string,string>").alias("properties"), F.lit(0.5).alias("confidence"), none.cast("string").alias("merged_into"), none.cast("timestamp").alias("merged_at"), none.cast("timestamp").alias("created_at"),
    )
    edges = spark.createDataFrame([], "id string, user_id string, type string, semantic_type string, source_node_id string, source_type string, target_node_id string, target_type string, properties map<string,string>")
    pairs = c.select(k.alias("k")).join(c.select((k - 1).alias("k"), k.alias("after")), "k").where("k % 3 = 1")
    pairs = pairs.select(ident(F.col("k")).alias("low_id"), ident(F.col("after")).alias("high_id"), F.lit(0.9).alias("score"), F.lit("both").alias("match_type"), F.when(F.col("k") % 2 == 1, "merged").otherwise("flagged").alias("action"))
    now = F.lit("2024-06-01").cast("timestamp")
    out, links = dedup.apply_sweep(*dedup.apply_sweep(nodes, edges, pairs, now, dry_run=True), pairs, now)
    found = out.select(F.lit("node").alias("kind"), "id", F.when(F.col("merged_into").isNotNull(), "merged").otherwise("alive").alias("state"))
    return found.unionByName(links.select(F.lit("edge").alias("kind"), "id", F.element_at("properties", "status").alias("state")))
