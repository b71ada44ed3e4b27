"""Queries of the stages that take extracted rows into the graph's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ontology import Ontology
from ..operators import dedup, ingestion
from . import graph as G
from .queries_maintenance import _EDGES_SQL, _NODES_SQL, _SEM_PAIRS, _emitted_edges, _emitted_nodes
from .registry import query

_STRINGS = "map<string,string>"
_NOW = "2024-06-01"


def _ontology() -> Ontology:
    """The registered types, with the order that a person was met in."""
    known = Ontology()
    known.register_properties("person/individual", {"order": None})
    return known


def _text(value: str | None = None):
    return F.lit(value).cast("string")


def _current(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All customers as people of the graph, and no edges."""
    c = G.table(spark, sf_dir, "customer").select(G.tenant(F.col("c_nationkey")).alias("user_id"), F.lower("c_name").alias("name"), "c_mktsegment")
    old = F.lit("2020-01-01").cast("timestamp")
    values = {
        "id": T.node_id(F.col("user_id"), F.lit("person"), F.col("name")), "user_id": F.col("user_id"), "type": _text("person"), "subtype": _text("individual"), "name": F.col("name"), "canonical_name": F.col("name"),
        "aliases": F.array(F.concat(F.lit("mr "), "name")), "sources": F.array(_text("crm://all")), "properties": F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("order"), F.lit("none")),
        "confidence": F.lit(1.0), "embedding": F.lit(None).cast("array<double>"), "merged_into": _text(), "created_at": old, "updated_at": old,
    }
    edges = spark.createDataFrame([], "id string, user_id string, type string, semantic_type string, source_node_id string, source_type string, target_node_id string, target_type string, properties map<string,string>, sources array<string>, created_at timestamp, updated_at timestamp")
    return c.select(*[v.alias(k) for k, v in values.items()]), edges


def _emissions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What all orders say: a person in another spelling, an event, and that the one took part in the other."""
    o = G.customer_orders(spark, sf_dir)
    base = o.select(G.tenant(F.col("c_nationkey")).alias("user_id"), F.concat(F.lit("order://"), "o_orderkey").alias("source_uri"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("  "), F.upper("c_name")).alias("person"), F.concat(F.lit("Order "), "o_orderkey").alias("event"))
    common = ("user_id", "source_uri", "seq")
    # Both nodes of an order are made from one row, so that orders and customers are joined once.
    row = lambda kind, subtype, name, props: F.struct(_text(kind).alias("type"), _text(subtype).alias("subtype"), F.col(name).alias("name"), props.cast(_STRINGS).alias("properties"))
    both = F.array(row("person", "individual", "person", F.create_map(F.lit("order"), F.col("source_uri"))), row("event", "transaction", "event", F.create_map()))
    nodes = base.select(*common, F.inline(both))
    edge = base.select(
        *common, _text("related_to").alias("type"), _text("participated_in").alias("semantic_type"), _text("person").alias("source_type"), F.col("person").alias("source_name"),
        _text("event").alias("target_type"), F.col("event").alias("target_name"), F.create_map().cast(_STRINGS).alias("properties"),
    )
    return nodes, edge


def _written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _current(spark, sf_dir)
    found = ingestion.validate(*_emissions(spark, sf_dir), ontology=_ontology())
    return ingestion.apply_writes(nodes, edges, found.nodes, found.edges, F.lit(_NOW).cast("timestamp"))[:2]


_ORDERS_SQL = """WITH o AS (SELECT 't' || (c_nationkey % 3) AS u, o_orderkey AS k, lower(c_name) AS p FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT 't' || (c_nationkey % 3) AS u, lower(c_name) AS p FROM customer)
"""


@query(_ORDERS_SQL + """SELECT c.u || ':person:' || c.p AS id, count(o.k) + 1 AS n_sources, coalesce('order://' || max(o.k), 'none') AS last_order, count(o.k) > 0 AS changed FROM c LEFT JOIN o ON o.u = c.u AND o.p = c.p GROUP BY c.u, c.p
UNION ALL SELECT u || ':event:order ' || k, 1, NULL, true FROM o""")
def d29_apply_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes after the people and events of all orders came in."""
    nodes = _written(spark, sf_dir)[0]
    return nodes.select("id", F.size("sources").cast("long").alias("n_sources"), F.element_at("properties", "order").alias("last_order"), (F.col("updated_at") == F.lit(_NOW).cast("timestamp")).alias("changed"))


@query(_ORDERS_SQL + """SELECT u || ':person:' || p || '|related_to|' || u || ':event:order ' || k AS id, 'participated_in' AS semantic_type, 'order://' || k AS source FROM o
UNION ALL SELECT u || ':document:order://' || k || '|mentions|' || u || ':person:' || p, NULL, 'order://' || k FROM o""")
def s19_edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after the relations of all orders, and the mentions of people, came in."""
    return _written(spark, sf_dir)[1].select("id", "semantic_type", F.element_at("sources", 1).alias("source"))


@query(_ORDERS_SQL + """SELECT DISTINCT u || ':person:' || p AS id, p AS canonical_name, 'exact' AS match_type, 1.0 AS confidence FROM o
UNION ALL SELECT u || ':event:order ' || k, 'order ' || k, 'none', 1.0 FROM o""")
def d18_resolve_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emitted names with the nodes of the graph that they are."""
    found = ingestion.validate(*_emissions(spark, sf_dir), ontology=_ontology())
    resolved = ingestion.resolve_nodes(ingestion.collapse_nodes(found.nodes), _current(spark, sf_dir)[0])
    return resolved.select("id", "canonical_name", "match_type", "confidence")


@query(f"""WITH e AS ({_NODES_SQL}), k AS (SELECT id, type AS raw, CASE WHEN type = 'task' THEN 'object' ELSE type END AS type, CASE WHEN type = 'task' AND subtype IS NULL THEN 'task' ELSE subtype END AS subtype, trim(lower(coalesce(name, ''))) AS name FROM e),
n AS (SELECT id, CASE WHEN raw IS NULL THEN 'missing_type' WHEN type = 'alien' THEN 'unknown_type' WHEN type = 'chunk' THEN 'non_extractable_type' WHEN name = '' THEN 'missing_name'
WHEN type IN ('person', 'location', 'event', 'object') AND subtype IS NULL THEN 'missing_subtype'
WHEN type IN ('person', 'location', 'event', 'object') AND (type, subtype) NOT IN (('person', 'individual'), ('location', 'city'), ('object', 'device'), ('object', 'task')) THEN 'unknown_subtype' END AS reason FROM k),
f AS ({_EDGES_SQL}), g AS (SELECT id, type AS raw, CASE WHEN type IN ('todo', 'experienced') THEN 'related_to' ELSE type END AS type, CASE WHEN s = 'task' THEN 'object' ELSE s END AS s, CASE WHEN t = 'task' THEN 'object' ELSE t END AS t,
CASE type WHEN 'todo' THEN 'has_task' WHEN 'experienced' THEN 'experienced_by' ELSE sem END AS sem FROM f),
x AS (SELECT id, CASE WHEN raw IS NULL THEN 'missing_type' WHEN type NOT IN ('related_to', 'part_of') THEN 'unknown_type' WHEN type = 'part_of' THEN 'non_extractable_type' WHEN s IS NULL OR t IS NULL THEN 'missing_endpoint_type'
WHEN s = 'ghost' OR t = 'ghost' THEN 'invalid_endpoint_type' WHEN sem IS NULL THEN 'missing_semantic_type' WHEN sem = 'adores' THEN 'unknown_semantic' WHEN NOT {_SEM_PAIRS} THEN 'disallowed_pair' END AS reason FROM g)
SELECT id AS seq, 'node' AS kind, coalesce(reason, 'kept') AS outcome FROM n UNION ALL SELECT id, 'edge', coalesce(reason, 'kept') FROM x""")
def d7_validation_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emitted nodes and edges, kept or rejected with a reason."""
    where = {"user_id": _text("t"), "source_uri": _text("doc://1"), "properties": F.create_map().cast(_STRINGS)}
    nodes = _emitted_nodes(spark, sf_dir).withColumnRenamed("id", "seq").withColumns(where)
    edges = _emitted_edges(spark, sf_dir).withColumnsRenamed({"id": "seq", "source_node_id": "source_name", "target_node_id": "target_name"}).withColumns(where)
    found = ingestion.validate(nodes, edges)
    kept = [df.select("seq", F.lit(kind).alias("kind"), F.lit("kept").alias("outcome")) for df, kind in ((found.nodes, "node"), (found.edges, "edge"))]
    return found.rejected.select("seq", "kind", F.col("reason").alias("outcome")).unionByName(kept[0]).unionByName(kept[1])


@query(_ORDERS_SQL + "SELECT u AS user_id, 'order://' || k AS source_uri, 'node' AS kind, u || ':person:' || p AS id, 'order' AS field, 'order://' || k AS value, 'unknown_field' AS reason FROM o")
def d7_dropped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of all orders' people that the registered schemas do not know."""
    found = ingestion.validate(*_emissions(spark, sf_dir))
    return found.dropped.select("user_id", "source_uri", "kind", "id", "field", "value", "reason")


def _things(text: str) -> tuple[list[dict], list[dict]]:
    """A stand-in for a model: one thing a chunk, named by its number of words."""
    return [{"type": "object", "subtype": "device", "name": f"{len(text.split())} words"}], []


@query(G.GRAPH_SQL + """, c AS (SELECT 't' || (doc_id % 3) AS u, doc_id, chunk_index, len(regexp_extract_all(text, '\\S+')) AS n FROM chunks)
SELECT 'node' AS kind, 'document' AS type, count(DISTINCT doc_id) AS n FROM c UNION ALL SELECT 'node', 'chunk', count(*) FROM c UNION ALL SELECT 'node', 'object', count(DISTINCT (u, n)) FROM c
UNION ALL SELECT 'edge', 'part_of', count(*) FROM c UNION ALL SELECT 'edge', 'next', count(*) FROM c WHERE chunk_index > 0""")
def d29_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges by type after the whole write path over all documents."""
    docs = G.table(spark, sf_dir, "documents").select(G.tenant(F.col("doc_id")).alias("user_id"), F.concat(F.lit("doc://"), "doc_id").alias("source_uri"), F.col("text").alias("content"))
    nodes, edges = _current(spark, sf_dir)
    got = ingestion.ingest_documents(docs, nodes.limit(0), edges, _things, F.lit(_NOW).cast("timestamp"))
    count = lambda df, kind: df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(got.nodes, "node").unionByName(count(got.edges, "edge"))


_NEAR_SQL = """WITH v AS (SELECT 'v' || lpad(vec_id::VARCHAR, 6, '0') AS id, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT n.id, o.id AS near, round(list_cosine_similarity(n.e, o.e), 9) AS s FROM v n JOIN v o ON n.label = o.label WHERE n.vec_id % 2 = 1 AND o.vec_id % 2 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, near) AS r FROM c)
"""


@query(_NEAR_SQL + """SELECT 't:object:' || v.id AS id, CASE WHEN s >= 0.45 THEN 't:object:' || near ELSE 't:object:' || v.id END AS target_id, CASE WHEN s >= 0.45 THEN 'merged' WHEN s >= 0.35 THEN 'flagged' ELSE 'none' END AS action
FROM v LEFT JOIN b ON b.id = v.id AND r = 1 WHERE v.vec_id % 2 = 1""")
def d29_merge_and_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd rows of the vectors come into a graph of the even ones: merged into, flagged as like, or new beside the nearest."""
    e = G.table(spark, sf_dir, "embeddings")
    name = F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 6, "0"))
    user = F.lit("t")
    when = F.lit("2020-01-01").cast("timestamp")
    kind = F.concat(F.lit("kind "), F.col("label").cast("string"))
    # The label is the tenant here, so that only vectors of one label are compared.
    values = {
        "id": T.node_id(user, F.lit("object"), name), "user_id": kind, "type": _text("object"), "subtype": _text("device"), "name": name, "canonical_name": name, "aliases": F.array().cast("array<string>"),
        "sources": F.array(_text("old")), "properties": F.create_map().cast(_STRINGS), "confidence": F.lit(1.0), "embedding": F.col("embedding").cast("array<double>"), "merged_into": _text(), "created_at": when, "updated_at": when,
    }
    nodes = e.where("vec_id % 2 = 0").select(*[v.alias(k) for k, v in values.items()])
    new = e.where("vec_id % 2 = 1").select(kind.alias("user_id"), _text("doc://v").alias("source_uri"), F.col("vec_id").alias("seq"), _text("object").alias("type"), _text("device").alias("subtype"), name.alias("name"), F.create_map().cast(_STRINGS).alias("properties"), F.col("embedding").cast("array<double>").alias("embedding"))
    edges = _current(spark, sf_dir)[1]
    links = _emissions(spark, sf_dir)[1].limit(0)
    config = dedup.DedupConfig(merge=0.45, flag=0.35, use_fuzzy=False)
    decided = ingestion.apply_writes(nodes, edges, new, links, F.lit(_NOW).cast("timestamp"), config)[2]
    plain = lambda c: F.concat(F.lit("t:object:"), F.element_at(F.split(F.col(c), ":"), -1)).alias(c)
    return decided.select(plain("id"), plain("target_id"), "action")
