"""A knowledge graph derived from the star-schema tables, and the same graph in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import edge_id, node_id
from ..operators.chunking import chunk_texts
from ..operators.grouping import shuffled
from ..storage import written_once

CHUNK_WORDS, CHUNK_OVERLAP = 512, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tenant(key: Column) -> Column:
    return F.concat(F.lit("t"), (key % 3).cast("string"))


def _node(df: DataFrame, kind: str, subtype: str | None, user: Column, name: Column, **more: Column) -> DataFrame:
    cols = {
        "user_id": user,
        "type": F.lit(kind),
        "subtype": F.lit(subtype).cast("string"),
        "name": name,
        "aliases": F.array().cast("array<string>"),
        "properties": F.create_map().cast("map<string,string>"),
        "created_at": F.lit(None).cast("timestamp"),
    } | more
    named = df.select(*[c.alias(k) for k, c in cols.items()])
    return named.select(node_id(F.col("user_id"), F.col("type"), F.col("name")).alias("id"), *cols)


def chunks(documents: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """doc_id, chunk_index and text: windows of words."""
    return chunk_texts(documents, ["doc_id"], "text", size, overlap)


def chunk_places(documents: DataFrame) -> DataFrame:
    """doc_id and chunk_index of all chunks, from the number of words alone."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+"))
    counted = documents.select("doc_id", F.floor((n + (CHUNK_WORDS - CHUNK_OVERLAP - 1)) / (CHUNK_WORDS - CHUNK_OVERLAP)).alias("n"))
    return counted.where("n > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("chunk_index"))


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    return orders.join(shuffled(customers), orders.o_custkey == customers.c_custkey)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, type, subtype, name, aliases, properties and created_at of all nodes."""
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tenants = F.explode(F.array(*[F.lit(f"t{i}") for i in range(3)]))
    co = customer_orders(spark, sf_dir)
    parts = (
        t("lineitem").select("l_orderkey", "l_partkey")
        .join(shuffled(co.select("o_orderkey", tenant(F.col("c_nationkey")).alias("user"))), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("user", "l_partkey").distinct()
        .join(shuffled(t("part").select("p_partkey", "p_name")), F.col("l_partkey") == F.col("p_partkey"))
    )
    props = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))])
    doc_chunks = chunk_places(t("documents"))
    parts_of_graph = [
        _node(t("customer"), "person", "individual", tenant(F.col("c_nationkey")), F.lower("c_name"), properties=props(segment=F.col("c_mktsegment"), acctbal=F.col("c_acctbal"))),
        _node(t("supplier"), "organization", "company", tenant(F.col("s_nationkey")), F.lower("s_name")),
        _node(nation.select("n_name", "r_name", tenants.alias("user")), "location", "country", F.col("user"), F.lower("n_name"), properties=props(region=F.col("r_name"))),
        _node(co, "event", "transaction", tenant(F.col("c_nationkey")), F.concat(F.lit("order#"), F.col("o_orderkey")), created_at=F.col("o_orderdate")),
        _node(parts, "object", "device", F.col("user"), F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")), aliases=F.array("p_name")),
        _node(t("documents"), "document", None, tenant(F.col("doc_id")), F.concat(F.lit("doc://"), F.col("doc_id"))),
        _node(doc_chunks, "chunk", None, tenant(F.col("doc_id")), _chunk_name(F.col("doc_id"), F.col("chunk_index"))),
    ]
    return reduce(DataFrame.unionByName, parts_of_graph)


def _chunk_name(doc: Column, index: Column) -> Column:
    return F.concat(F.lit("doc://"), doc, F.lit("#chunk-"), index)


def _edge(df: DataFrame, kind: str, semantic: str | None, user: Column, source: tuple[str, Column], target: tuple[str, Column]) -> DataFrame:
    ends = df.select(user.alias("user_id"), node_id(user, F.lit(source[0]), source[1]).alias("source_node_id"), node_id(user, F.lit(target[0]), target[1]).alias("target_node_id"))
    return ends.select(
        edge_id(F.col("source_node_id"), F.lit(kind), F.col("target_node_id")).alias("id"), "user_id", F.lit(kind).alias("type"), F.lit(semantic).cast("string").alias("semantic_type"),
        "source_node_id", F.lit(source[0]).alias("source_type"), "target_node_id", F.lit(target[0]).alias("target_type"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, type, semantic_type and both ends of all edges."""
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation").select("n_nationkey", F.lower("n_name").alias("country"))
    co = customer_orders(spark, sf_dir).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    order = F.concat(F.lit("order#"), F.col("o_orderkey"))
    # One shuffle by order serves both the distinct rows and the join.
    items = t("lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    items = items.join(shuffled(co.select("o_orderkey", "c_nationkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.join(shuffled(t("part").select("p_partkey", "p_name")), F.col("l_partkey") == F.col("p_partkey"))
    part = F.concat_ws("#", "p_name", F.col("p_partkey").cast("string"))
    doc_chunks = chunk_places(t("documents"))
    by = tenant(F.col("c_nationkey"))
    of = tenant(F.col("doc_id"))
    chunk = lambda shift=0: _chunk_name(F.col("doc_id"), F.col("chunk_index") - shift)
    found = [
        _edge(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "related_to", "resides_at", by, ("person", F.lower("c_name")), ("location", F.col("country"))),
        _edge(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "related_to", "headquarters_at", tenant(F.col("s_nationkey")), ("organization", F.lower("s_name")), ("location", F.col("country"))),
        _edge(co, "related_to", "participated_in", by, ("person", F.lower("c_name")), ("event", order)),
        _edge(co, "related_to", "occurred_at", by, ("event", order), ("location", F.col("country"))),
        _edge(items, "related_to", "involved", by, ("object", part), ("event", order)),
        _edge(doc_chunks, "part_of", None, of, ("chunk", chunk()), ("document", F.concat(F.lit("doc://"), F.col("doc_id")))),
        _edge(doc_chunks.where("chunk_index > 0"), "next", None, of, ("chunk", chunk(1)), ("chunk", chunk())),
    ]
    return reduce(DataFrame.unionByName, found)


#: Events whose type names a preference category, for the derived preferences.
CATEGORY_OF = {"click": "ui", "view": "aesthetic", "purchase": "food", "signup": "social"}


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One preference for each user, event type and value, valid from its first event.

    user_id, name, category, statement and valid_from.
    """
    events = table(spark, sf_dir, "events").select(tenant(F.col("user_id")).alias("user"), "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), F.col("ts").cast("timestamp").alias("ts"))
    first = events.groupBy("user", "user_id", "event_type", "k").agg(F.min("ts").alias("valid_from"))
    category = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_OF.items() for x in kv]), F.col("event_type")), F.lit("other"))
    statement = F.concat_ws(" ", F.lit("prefers"), "event_type", "k")
    name = F.concat_ws("-", F.lit("user"), F.col("user_id").cast("string"), F.lit("prefers"), "event_type", "k")
    return first.select(F.col("user").alias("tenant"), "user_id", name.alias("name"), category.alias("category"), statement.alias("statement"), "valid_from")


#: The same tables as common table expressions of DuckDB.
GRAPH_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\S+') AS w FROM documents
), chunks AS (
  SELECT doc_id, i AS chunk_index, array_to_string(list_slice(w, i * 448 + 1, i * 448 + 512), ' ') AS text
  FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 447) // 448)) AS i FROM words)
), co AS (
  SELECT o_orderkey, o_orderdate, c_custkey, lower(c_name) AS person, c_nationkey, lower(n_name) AS country, 't' || (c_nationkey % 3) AS u
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), items AS (
  SELECT DISTINCT u, o_orderkey, p_partkey, p_name FROM lineitem JOIN co ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), raw_nodes(user_id, type, subtype, name, created_at) AS (
  SELECT 't' || (c_nationkey % 3), 'person', 'individual', lower(c_name), NULL::TIMESTAMP FROM customer
  UNION ALL SELECT 't' || (s_nationkey % 3), 'organization', 'company', lower(s_name), NULL FROM supplier
  UNION ALL SELECT 't' || i, 'location', 'country', lower(n_name), NULL FROM nation, range(3) r(i)
  UNION ALL SELECT u, 'event', 'transaction', 'order#' || o_orderkey, o_orderdate FROM co
  UNION ALL SELECT DISTINCT u, 'object', 'device', p_name || '#' || p_partkey, NULL FROM items
  UNION ALL SELECT 't' || (doc_id % 3), 'document', NULL, 'doc://' || doc_id, NULL FROM documents
  UNION ALL SELECT 't' || (doc_id % 3), 'chunk', NULL, 'doc://' || doc_id || '#chunk-' || chunk_index, NULL FROM chunks
), nodes AS (
  SELECT user_id || ':' || type || ':' || name AS id, * FROM raw_nodes
), raw_edges(user_id, type, semantic_type, source_type, s, target_type, t) AS (
  SELECT 't' || (c_nationkey % 3), 'related_to', 'resides_at', 'person', lower(c_name), 'location', lower(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 't' || (s_nationkey % 3), 'related_to', 'headquarters_at', 'organization', lower(s_name), 'location', lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT u, 'related_to', 'participated_in', 'person', person, 'event', 'order#' || o_orderkey FROM co
  UNION ALL SELECT u, 'related_to', 'occurred_at', 'event', 'order#' || o_orderkey, 'location', country FROM co
  UNION ALL SELECT u, 'related_to', 'involved', 'object', p_name || '#' || p_partkey, 'event', 'order#' || o_orderkey FROM items
  UNION ALL SELECT 't' || (doc_id % 3), 'part_of', NULL, 'chunk', 'doc://' || doc_id || '#chunk-' || chunk_index, 'document', 'doc://' || doc_id FROM chunks
  UNION ALL SELECT 't' || (doc_id % 3), 'next', NULL, 'chunk', 'doc://' || doc_id || '#chunk-' || (chunk_index - 1), 'chunk', 'doc://' || doc_id || '#chunk-' || chunk_index FROM chunks WHERE chunk_index > 0
), edges AS (
  SELECT user_id || ':' || source_type || ':' || s || '|' || type || '|' || user_id || ':' || target_type || ':' || t AS id,
         user_id, type, semantic_type, user_id || ':' || source_type || ':' || s AS source_node_id, source_type,
         user_id || ':' || target_type || ':' || t AS target_node_id, target_type
  FROM raw_edges
), preferences AS (
  SELECT 't' || (user_id % 3) AS tenant, user_id, 'user-' || user_id || '-prefers-' || event_type || '-' || (props::JSON ->> '$.k') AS name,
         CASE event_type WHEN 'click' THEN 'ui' WHEN 'view' THEN 'aesthetic' WHEN 'purchase' THEN 'food' WHEN 'signup' THEN 'social' ELSE 'other' END AS category,
         'prefers ' || event_type || ' ' || (props::JSON ->> '$.k') AS statement, min(ts) AS valid_from
  FROM events GROUP BY ALL
)
"""


def walkable_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk reads of the edges, derived once for an application and input: each step scans this table, not the joins behind it.

    An id is its ends and type, so it is put together where it is read.
    """
    held = written_once(spark, f"edges {sf_dir}", lambda: edges(spark, sf_dir).select("user_id", "source_node_id", "target_node_id", "type"))
    return held.select(edge_id(F.col("source_node_id"), F.col("type"), F.col("target_node_id")).alias("id"), "user_id", "source_node_id", "target_node_id", "type")
