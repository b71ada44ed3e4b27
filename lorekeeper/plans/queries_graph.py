"""Queries over the derived graph: scans, filters, joins, aggregates, windows, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batching, filters, supersession, traversal
from ..operators.resolution import remap_endpoints
from . import graph as G
from .graph import GRAPH_SQL as KG
from .registry import query

_NODE = ["id", "user_id", "type", "subtype", "name"]


@query(KG + "SELECT type, count(*) AS n FROM nodes WHERE user_id = 't1' GROUP BY type UNION ALL SELECT 'edge:' || type, count(*) FROM edges WHERE user_id = 't1' GROUP BY type")
def s24_full_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes and edges of a tenant, counted by type."""
    q = filters.GraphQuery("t1", G.nodes(spark, sf_dir), G.edges(spark, sf_dir))
    edges = q.edges.groupBy(F.concat(F.lit("edge:"), "type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return q.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).unionByName(edges)


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def s25_collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table."""
    counts = [G.table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in _TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(KG + "SELECT id, user_id, type, subtype, name FROM nodes WHERE user_id = 't1' AND type = 'person'")
def p2_find_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a type, the caller's own user_id dropped."""
    q = filters.GraphQuery("t1", G.nodes(spark, sf_dir), G.edges(spark, sf_dir))
    return q.find_nodes("person", where={"user_id": "t2", "subtype": "individual"}).select(*_NODE)


@query(KG + "SELECT id, user_id, type, subtype, name FROM nodes WHERE id = 't0:location:nation_3'")
def p3_find_node_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node by id."""
    return filters.GraphQuery("t0", G.nodes(spark, sf_dir), G.edges(spark, sf_dir)).find_node_by_id("t0:location:nation_3").select(*_NODE)


@query(KG + "SELECT id, source_node_id, target_node_id FROM edges WHERE user_id = 't2' AND type = 'next'")
def p5_find_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a type."""
    q = filters.GraphQuery("t2", G.nodes(spark, sf_dir), G.edges(spark, sf_dir))
    return q.find_edges("next").select("id", "source_node_id", "target_node_id")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.table(spark, sf_dir, "customer")
    slots = F.create_map(F.lit("subject"), F.lower("c_name"), F.lit("predicate"), F.lit("in segment"), F.lit("object"), F.lower("c_mktsegment"))
    return c.select(F.concat(F.lit("fact#"), "c_custkey").alias("id"), G.tenant(F.col("c_nationkey")).alias("user_id"), F.lit("fact").alias("type"), slots.alias("properties"))


@query("SELECT 'fact#' || c_custkey AS id FROM customer WHERE c_nationkey % 3 = 0 AND lower(c_mktsegment) = 'building'")
def p6_find_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by exact slots."""
    facts = _facts(spark, sf_dir)
    return filters.GraphQuery("t0", facts, facts).find_facts(predicate="in segment", object="building").select("id")


_CHAIN = KG + """, chain AS (
  SELECT *, lag(statement) OVER w AS before FROM preferences WINDOW w AS (PARTITION BY tenant, user_id, category ORDER BY valid_from, name)
), changed AS (SELECT * FROM chain WHERE before IS NULL OR before <> statement), ended AS (
  SELECT *, lead(valid_from) OVER w AS valid_until, lead(name) OVER w AS superseded_by FROM changed WINDOW w AS (PARTITION BY tenant, user_id, category ORDER BY valid_from, name)
)
"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.preferences(spark, sf_dir).withColumn("id", F.col("name"))
    return supersession.supersede_by_rule(rows, ["tenant", "user_id", "category"])


@query(_CHAIN + "SELECT name, category, valid_from FROM ended WHERE valid_until IS NULL")
def p7_current_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences that hold now."""
    return filters.current(_chain(spark, sf_dir)).select("name", "category", "valid_from")


@query(_CHAIN + "SELECT name, category FROM ended WHERE valid_from <= '2024-01-16' AND (valid_until IS NULL OR valid_until > '2024-01-16')")
def p8_preferences_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences that held at a moment."""
    return filters.valid_at(_chain(spark, sf_dir), F.lit("2024-01-16").cast("timestamp")).select("name", "category")


@query(_CHAIN + "SELECT name, superseded_by, valid_until, CASE WHEN superseded_by IS NOT NULL THEN 'contradiction' END AS reason FROM ended")
def w3_supersession_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each preference with its end and its successor."""
    return _chain(spark, sf_dir).select("name", "superseded_by", "valid_until", "reason")


@query(KG + "SELECT name, r - 1 AS rank FROM (SELECT name, row_number() OVER (PARTITION BY tenant, user_id, category ORDER BY valid_from DESC, name) AS r FROM preferences) WHERE r <= 8")
def w2_recent_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most recent preferences of each user and category."""
    rows = G.preferences(spark, sf_dir).withColumns({"id": F.col("name"), "created_at": F.col("valid_from")})
    return supersession.recent_candidates(rows, ["tenant", "user_id", "category"]).select("name", "rank")


@query(KG + "SELECT DISTINCT tenant || ':person:self|has|' || tenant || ':preference:' || name AS id FROM preferences")
def d12_has_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``has`` edges from each tenant's person to its preferences."""
    rows = G.preferences(spark, sf_dir).select(F.col("tenant").alias("user_id"), T.node_id(F.col("tenant"), F.lit("preference"), F.col("name")).alias("id"))
    return supersession.has_edges(rows).select("id")


@query("SELECT 'user-' || user_id || '-' || event_type AS id FROM events GROUP BY user_id, event_type HAVING max(ts) > '2024-01-16'")
def p11_changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows touched after a watermark."""
    e = G.table(spark, sf_dir, "events")
    rows = e.groupBy("user_id", "event_type").agg(F.max(F.col("ts").cast("timestamp")).alias("updated_at"))
    return filters.changed_since(rows, F.lit("2024-01-16").cast("timestamp")).select(F.concat_ws("-", F.lit("user"), "user_id", "event_type").alias("id"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' ORDER BY user_id")
def p14_active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users that are active, in order."""
    return G.table(spark, sf_dir, "events").where(F.col("event_type") == "purchase").select("user_id").distinct().orderBy("user_id")


@query("SELECT doc_id FROM documents WHERE coalesce(text, '') <> '' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def p15_pending_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no node came from; labelled ones stand for those that are in."""
    from ..operators.writes import pending_documents

    docs = G.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    used = G.table(spark, sf_dir, "labels").select(F.array("doc_id").alias("sources"))
    return pending_documents(docs, used).select("doc_id")


@query(KG + "SELECT e.id, s.name AS source_name, t.name AS target_name FROM edges e JOIN nodes s ON s.id = e.source_node_id JOIN nodes t ON t.id = e.target_node_id WHERE e.semantic_type = 'headquarters_at'")
def j1_hydrate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the names of both ends."""
    nodes, edges = G.nodes(spark, sf_dir), G.edges(spark, sf_dir).where(F.col("semantic_type") == "headquarters_at")
    for side in ("source", "target"):
        edges = edges.join(nodes.select(F.col("id").alias(f"{side}_node_id"), F.col("name").alias(f"{side}_name")), f"{side}_node_id")
    return edges.select("id", "source_name", "target_name")


@query(KG + "SELECT id, name FROM nodes n WHERE type = 'location' AND EXISTS (SELECT 1 FROM edges e WHERE e.target_node_id = n.id AND e.semantic_type = 'resides_at')")
def j4_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations where someone resides."""
    nodes = G.nodes(spark, sf_dir).where(F.col("type") == "location")
    ends = G.edges(spark, sf_dir).where(F.col("semantic_type") == "resides_at").select(F.col("target_node_id").alias("id"))
    return nodes.join(ends, "id", "left_semi").select("id", "name")


@query(KG + "SELECT id, name FROM nodes n WHERE type = 'location' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_node_id = n.id AND e.semantic_type = 'headquarters_at')")
def j3_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations without a headquarters."""
    nodes = G.nodes(spark, sf_dir).where(F.col("type") == "location")
    ends = G.edges(spark, sf_dir).where(F.col("semantic_type") == "headquarters_at").select(F.col("target_node_id").alias("id"))
    return nodes.join(ends, "id", "left_anti").select("id", "name")


_SEED = "t1:location:nation_7"
_WALK = KG + f""", d0 AS (SELECT id, source_node_id, target_node_id FROM edges WHERE source_node_id = '{_SEED}'),
d1 AS (SELECT e.id, e.source_node_id, e.target_node_id FROM edges e WHERE e.source_node_id IN (SELECT target_node_id FROM d0)),
u0 AS (SELECT id, source_node_id, target_node_id FROM edges WHERE target_node_id = '{_SEED}'),
u1 AS (SELECT e.id, e.source_node_id, e.target_node_id FROM edges e WHERE e.target_node_id IN (SELECT source_node_id FROM u0)),
walk AS (SELECT * FROM d0 UNION SELECT * FROM d1 UNION SELECT * FROM u0 UNION SELECT * FROM u1)
"""


@query(_WALK + "SELECT id, source_node_id, target_node_id FROM walk")
def j5_expand_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges within two hops of a node, walked down and up."""
    seeds = spark.createDataFrame([(_SEED,)], "id string")
    return traversal.expand_graph(G.nodes(spark, sf_dir), G.walkable_edges(spark, sf_dir), seeds, 2)[1].select("id", "source_node_id", "target_node_id")


@query(_WALK + f"SELECT id, type FROM nodes WHERE id IN (SELECT source_node_id FROM walk UNION SELECT target_node_id FROM walk UNION SELECT '{_SEED}')")
def j5_expand_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two hops of a node."""
    seeds = spark.createDataFrame([(_SEED,)], "id string")
    return traversal.expand_graph(G.nodes(spark, sf_dir), G.walkable_edges(spark, sf_dir), seeds, 2)[0].select("id", "type")


@query(KG + f""", links AS (SELECT source_node_id AS a, target_node_id AS b FROM edges WHERE type = 'related_to' UNION ALL SELECT target_node_id, source_node_id FROM edges WHERE type = 'related_to'),
h1 AS (SELECT DISTINCT b AS id FROM links WHERE a = '{_SEED}' AND b <> '{_SEED}'), h2 AS (SELECT DISTINCT b AS id FROM links WHERE a IN (SELECT id FROM h1) AND b <> '{_SEED}' AND b NOT IN (SELECT id FROM h1))
SELECT id, 1 AS hops FROM h1 UNION ALL SELECT id, 2 FROM h2""")
def j6_find_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two hops over edges taken either way."""
    return traversal.find_neighbors(G.walkable_edges(spark, sf_dir), _SEED, 2, ["related_to"])


@query(KG + ", kept AS (SELECT * FROM nodes WHERE type <> 'location') SELECT DISTINCT x.id, 'unknown' AS type FROM (SELECT source_node_id AS id FROM edges UNION SELECT target_node_id FROM edges) x WHERE x.id NOT IN (SELECT id FROM kept)")
def j13_missing_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of edges that are not among the nodes, locations being left out."""
    nodes = G.nodes(spark, sf_dir).where(F.col("type") != "location")
    return traversal.missing_endpoints(nodes, G.edges(spark, sf_dir)).select("id", "type")


@query(KG + """SELECT replace(source_node_id, 't0:organization:supplier#000000000', 't0:organization:main') AS source_node_id, target_node_id FROM edges WHERE semantic_type = 'headquarters_at'""")
def j10_remap_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ends are replaced by what they were resolved to."""
    edges = G.edges(spark, sf_dir).where(F.col("semantic_type") == "headquarters_at")
    to = spark.createDataFrame([("t0:organization:supplier#000000000", "t0:organization:main")], "built_id string, node_id string")
    return remap_endpoints(edges, to).select("source_node_id", "target_node_id")


@query(KG + "SELECT type, count(*) AS n FROM nodes GROUP BY type")
def g1_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by type, most frequent first."""
    return G.nodes(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


@query("SELECT user_id, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value <= 50) AS low, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def g5_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts of a run."""
    return G.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value") <= 50).alias("low"), F.countDistinct("event_type").alias("kinds"))


@query("SELECT source, count(*) AS n FROM (SELECT source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1 GROUP BY source")
def g7_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts, each counted for the source of its first document."""
    first = G.table(spark, sf_dir, "documents").groupBy("text").agg(F.min_by("source", "doc_id").alias("source"))
    return first.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lang, sum(tokens) AS tokens, round(sum(tokens) / 1e6 * CASE lang WHEN 'en' THEN 0.06 WHEN 'fr' THEN 0.12 ELSE 0 END, 9) AS cost
FROM (SELECT lang, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) // 3 + 1 END AS tokens FROM documents) GROUP BY lang""")
def g8_embedding_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens and their cost; a model without a price costs nothing."""
    prices = spark.createDataFrame([("en", 0.06), ("fr", 0.12)], "lang string, price double")
    used = G.table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"))
    return used.join(prices, "lang", "left").select("lang", "tokens", F.round(F.col("tokens") / 1e6 * F.coalesce("price", F.lit(0.0)), 9).alias("cost"))


@query(KG + "SELECT source_node_id, target_node_id FROM edges WHERE type = 'next'")
def w4_chunk_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk after the one before it, by a lag."""
    rows = G.chunks(G.table(spark, sf_dir, "documents"))
    name = T.node_id(G.tenant(F.col("doc_id")), F.lit("chunk"), F.concat(F.lit("doc://"), "doc_id", F.lit("#chunk-"), "chunk_index"))
    rows = rows.select("doc_id", "chunk_index", name.alias("target_node_id"))
    before = F.lag("target_node_id").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return rows.withColumn("source_node_id", before).where("source_node_id is not null").select("source_node_id", "target_node_id")


@query(KG + "SELECT doc_id, chunk_index, md5(text) AS digest FROM chunks")
def d1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 512 words that overlap by 64."""
    return G.chunks(G.table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(KG + "SELECT id, name FROM nodes WHERE type IN ('document', 'chunk') UNION ALL SELECT id, NULL FROM edges WHERE type IN ('part_of', 'next')")
def d2_structural_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and chunk nodes with their edges."""
    nodes = G.nodes(spark, sf_dir).where(F.col("type").isin("document", "chunk")).select("id", "name")
    edges = G.edges(spark, sf_dir).where(F.col("type").isin("part_of", "next")).select("id", F.lit(None).cast("string").alias("name"))
    return nodes.unionByName(edges)


@query("SELECT doc_id, ntile(7) OVER (PARTITION BY source ORDER BY doc_id) - 1 AS shard FROM documents")
def d39_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous shards of each source, sized alike."""
    return batching.balanced_shards(G.table(spark, sf_dir, "documents"), 7, "doc_id", ["source"]).select("doc_id", "shard")


@query("""WITH t AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT source, i AS part, i * (n // 4) AS "offset", CASE WHEN i = 3 THEN n - 3 * (n // 4) ELSE n // 4 END AS size FROM t, range(4) r(i)""")
def d40_offset_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that tile each source's rows."""
    n = G.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", F.posexplode(batching.offset_windows(F.col("n"), 4)).alias("part", "w")).select("source", "part", "w.offset", "w.size")


@query("""WITH RECURSIVE d AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) // 3 + 1 END AS tokens FROM documents),
f AS (SELECT source, r, doc_id, 0::BIGINT AS batch, 1 AS c, tokens AS used FROM d WHERE r = 1
UNION ALL SELECT d.source, d.r, d.doc_id, CASE WHEN f.c + 1 > 20 OR f.used + d.tokens > 10000 THEN f.batch + 1 ELSE f.batch END,
CASE WHEN f.c + 1 > 20 OR f.used + d.tokens > 10000 THEN 1 ELSE f.c + 1 END, CASE WHEN f.c + 1 > 20 OR f.used + d.tokens > 10000 THEN d.tokens ELSE f.used + d.tokens END
FROM f JOIN d ON d.source = f.source AND d.r = f.r + 1) SELECT doc_id, batch FROM f""")
def d19_pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source packed by count and tokens."""
    rows = G.table(spark, sf_dir, "documents").select("source", "doc_id", T.token_estimate(F.col("text")).alias("tokens"))
    return batching.pack_batches(rows, ["source"], "doc_id", "tokens", max_inputs=20).select("doc_id", "batch")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u5_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without those that have labels."""
    return G.table(spark, sf_dir, "documents").select("doc_id").subtract(G.table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def u4_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have labels."""
    return G.table(spark, sf_dir, "documents").select("doc_id").intersect(G.table(spark, sf_dir, "labels").select("doc_id"))


@query(KG + "SELECT DISTINCT name FROM (SELECT name FROM nodes WHERE type = 'organization' UNION SELECT upper(name) FROM nodes WHERE type = 'organization')")
def u3_name_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and canonical names as one set."""
    n = G.nodes(spark, sf_dir).where(F.col("type") == "organization")
    return n.select("name").union(n.select(F.upper("name"))).distinct()


@query(KG + "SELECT id, type || ': ' || name || ' — ' || user_id AS summary FROM nodes WHERE type = 'organization' UNION ALL SELECT id, source_node_id || ' —[' || type || ']→ ' || target_node_id FROM edges WHERE semantic_type = 'headquarters_at'")
def s22_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each node or edge of a deep search."""
    n = G.nodes(spark, sf_dir).where(F.col("type") == "organization").select("id", F.concat(F.col("type"), F.lit(": "), "name", F.lit(" — "), "user_id").alias("summary"))
    e = G.edges(spark, sf_dir).where(F.col("semantic_type") == "headquarters_at").select("id", F.concat("source_node_id", F.lit(" —["), "type", F.lit("]→ "), "target_node_id").alias("summary"))
    return n.unionByName(e)


@query("SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n_events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2, 3")
def x1_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of events; the same plan runs as a stream."""
    from ..streaming.events import windowed_counts

    return windowed_counts(G.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM h GROUP BY user_id, k""")
def x2_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user."""
    from ..streaming.events import sessions

    return sessions(G.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("SELECT coalesce(n_name, 'all') AS nation, coalesce(c_mktsegment, 'all') AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment)")
def x3_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation and segment with all subtotals."""
    rows = G.table(spark, sf_dir, "customer").join(G.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cube = rows.cube("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return cube.select(F.coalesce("n_name", F.lit("all")).alias("nation"), F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "n")
