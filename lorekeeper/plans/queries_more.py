"""Further queries: predicates, joins, caps, keys and records that the other modules do not show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W
from ..operators import dedup, filters, ordering, traversal
from ..sources import documents as D
from . import graph as G
from .graph import GRAPH_SQL as KG
from .registry import query


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    gone = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit("other"))
    return e.select(k.alias("id"), gone.alias("merged_into"), F.when(k % 4 == 0, F.array().cast("array<float>")).when(k % 4 > 1, F.col("embedding")).alias("embedding"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 <> 1")
def p9_live_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a tombstone: missing, null and empty are one."""
    return filters.live(_marked(spark, sf_dir)).select("id")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 4 > 1")
def p10_embedded_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have a vector."""
    return filters.embedded(_marked(spark, sf_dir)).select("id")


@query(KG + "SELECT id, name FROM nodes WHERE id IN (SELECT 't1:location:' || lower(n_name) FROM nation WHERE n_regionkey = 2)")
def p12_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose ids are in a table of ids."""
    ids = G.table(spark, sf_dir, "nation").where("n_regionkey = 2").select(T.node_id(F.lit("t1"), F.lit("location"), F.lower("n_name")).alias("id"))
    return G.nodes(spark, sf_dir).join(ids, "id", "left_semi").select("id", "name")


@query("SELECT page_id, page_id % 4 <> 1 AND page_id % 4 <> 2 AS organic FROM pages")
def p18_organic_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that lead away from the search engine."""
    urls = F.array(F.col("url"), F.lit("https://maps.google.com/x"), F.lit("https://www.gstatic.com/y"), F.lit("https://notgoogle.com/"))
    return G.table(spark, sf_dir, "pages").select("page_id", W.is_organic(F.get(urls, (F.col("page_id") % 4).cast("int"))).alias("organic"))


@query("SELECT c_custkey AS id, 'balance=' || CASE WHEN c_custkey % 2 = 0 THEN '1.235' ELSE '0.5' END || ';segment=' || c_mktsegment AS meta FROM customer")
def p19_curated_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata without empty values, numbers rounded to three places."""
    number = F.round(F.when(F.col("c_custkey") % 2 == 0, F.lit(1.23456)).otherwise(F.lit(0.5)), 3).cast("string")
    raw = F.create_map(F.lit("balance"), number, F.lit("empty"), F.lit(""), F.lit("segment"), F.col("c_mktsegment"))
    kept = F.array_sort(F.map_entries(F.map_filter(raw, lambda k, v: v.isNotNull() & (v != ""))))
    return G.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(F.transform(kept, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("meta"))


@query(KG + "SELECT id FROM edges WHERE source_node_id = 't1:location:nation_7' OR target_node_id = 't1:location:nation_7'")
def u1_edge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges into and out of a node as one set."""
    e = G.edges(spark, sf_dir)
    seed = "t1:location:nation_7"
    return e.where(F.col("source_node_id") == seed).unionByName(e.where(F.col("target_node_id") == seed)).dropDuplicates(["id"]).select("id")


@query("SELECT doc_id AS id, 'a' AS run FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'b' FROM documents WHERE doc_id % 3 = 0")
def u2_concatenated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two runs, one after the other, repeats kept."""
    d = G.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return D.union_all([d.where("id % 2 = 0").withColumn("run", F.lit("a")), d.where("id % 3 = 0").withColumn("run", F.lit("b"))])


@query("SELECT DISTINCT least(s_suppkey, (s_suppkey * 7) % 100) AS low_id, greatest(s_suppkey, (s_suppkey * 7) % 100) AS high_id FROM supplier WHERE s_suppkey <> (s_suppkey * 7) % 100")
def j8_ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs, each once."""
    s = G.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") * 7 % 100).alias("b")).where("a <> b")
    return dedup.ordered_pairs(s, "a", "b").select("low_id", "high_id").distinct()


@query("SELECT o_custkey AS video_id, arg_min(o_orderkey, o_orderkey) AS record FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j12_first_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of each key, null where a key has none."""
    records = G.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("record"))
    return ordering.first_records(G.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id")), records, "video_id", ["record"], ["record"])


@query("SELECT s_suppkey AS a, p_partkey AS b FROM supplier JOIN part ON s_suppkey % 10 = p_partkey % 10 AND abs(s_suppkey - p_partkey) <= 20")
def j7_blocked_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one block that fulfil a condition on both."""
    s = G.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") % 10).alias("block"))
    p = G.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("b"), (F.col("p_partkey") % 10).alias("block"))
    return ordering.banded_pairs(s, p, ["block"], "a", "b", 20).select("a", "b")


@query("""WITH s AS (SELECT user_id, ts, value, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM events WHERE event_type = 'signup')
SELECT e.event_id, s.value AS as_of FROM events e LEFT JOIN s ON s.user_id = e.user_id AND e.ts >= s.ts AND (e.ts < s.until OR s.until IS NULL) WHERE e.event_type = 'purchase'""")
def j14_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the user's last signup before it."""
    e = G.table(spark, sf_dir, "events")
    signups = e.where("event_type = 'signup'").select("user_id", "ts", F.col("value").alias("as_of"))
    return ordering.as_of_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), signups, ["user_id"], "ts", ["as_of"]).select("event_id", "as_of")


@query("""SELECT 't' || c_custkey AS a FROM customer WHERE c_custkey = 42
UNION SELECT 't' || CASE WHEN c_custkey // 2 = 42 THEN c_custkey ELSE c_custkey // 2 END FROM customer WHERE c_custkey // 2 = 42 OR c_custkey = 42""")
def g6_same_as_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer and all customers one same_as edge away, each customer being linked to that of half its key."""
    name = lambda c: F.concat(F.lit("t"), c.cast("long").cast("string"))
    k = F.col("c_custkey")
    edges = G.table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), name(k).alias("source_node_id"), name(F.floor(k / 2)).alias("target_node_id"), F.lit("same_as").alias("type"))
    return traversal.same_as_cluster(edges, "t42").select(F.col("id").alias("a"))


@query("SELECT c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def w6_sort_and_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by several keys."""
    return G.table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(15).select(F.col("c_custkey").alias("id"))


@query(KG + "SELECT id FROM (SELECT id, 0 AS k FROM nodes WHERE type = 'organization' AND user_id = 't1' UNION ALL SELECT id, 1 FROM edges WHERE semantic_type = 'headquarters_at' AND user_id = 't1') ORDER BY k, id LIMIT 40")
def w8_nodes_then_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result's nodes, then its edges, up to what a caller asked for."""
    n = G.nodes(spark, sf_dir).where("type = 'organization' and user_id = 't1'").select("id", F.lit(0).alias("k"))
    e = G.edges(spark, sf_dir).where("semantic_type = 'headquarters_at' and user_id = 't1'").select("id", F.lit(1).alias("k"))
    return n.unionByName(e).orderBy("k", "id").limit(40).select("id")


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS rank, doc_id FROM documents WHERE lang = 'es'")
def w1_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0-based ranks in a language, counted over ranges."""
    return ordering.global_rank(G.table(spark, sf_dir, "documents").where(F.col("lang") == "es").select("doc_id"), "doc_id")


@query("SELECT DISTINCT 'user-' || user_id || '-prefers-' || event_type AS name FROM events")
def d9_preference_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences named by the slug of their statement."""
    e = G.table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return e.select(T.slugify(F.concat(F.lit("User "), "user_id", F.lit(" prefers: "), "event_type", F.lit("!"))).alias("name"))


@query("SELECT source AS family, doc_id, count(*) OVER (PARTITION BY source) AS n FROM documents")
def d41_platform_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family of every document, a row each, with the size of the family, counted before the join."""
    d = G.table(spark, sf_dir, "documents").select(F.col("source").alias("family"), "doc_id")
    sizes = d.groupBy(F.col("family").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    return d.join(sizes, F.col("family").eqNullSafe(F.col("of"))).select("family", "doc_id", "n")


@query("SELECT doc_id AS video_id, CASE WHEN doc_id % 2 = 0 THEN 'E' || doc_id % 5 || ': failed' END AS ingest_error, CASE WHEN doc_id % 2 = 1 THEN source END AS content FROM documents")
def d43_failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed records keep their place, with an error and no content."""
    d = G.table(spark, sf_dir, "documents")
    bad = F.col("doc_id") % 2 == 0
    return d.select(F.col("doc_id").alias("video_id"), F.when(bad, F.concat(F.lit("E"), F.col("doc_id") % 5, F.lit(": failed"))).alias("ingest_error"), F.when(~bad, F.col("source")).alias("content"))


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, c_name) AS title, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'base' END AS channel FROM customer")
def xs25_metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that an override has, else those of the base."""
    c = G.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    base = c.select(k.alias("id"), F.col("c_name").alias("title"), F.lit("base").alias("channel"))
    override = c.select(k.alias("id"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("title"), F.when(k % 3 == 0, F.lit("new")).alias("channel"))
    return ordering.merged_fields(base, override, "id")


@query("SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id / 1000.0 END, 6) AS s FROM events")
def xs26_safe_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds as seconds; what is no number is 0."""
    e = G.table(spark, sf_dir, "events")
    return e.select("event_id", F.round(W.seconds(F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise(F.col("event_id").cast("string"))), 6).alias("s"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) ELSE TIMESTAMP '2000-01-01' END AS at FROM events""")
def xs27_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO and RFC 2822 dates, else a fallback."""
    e = G.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.lit("soon"))
    return e.select("event_id", W.parse_date(raw, F.lit("2000-01-01").cast("timestamp")).alias("at"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN TRY_CAST(props::JSON ->> '$.k' AS BIGINT) ELSE -1 END AS k FROM events")
def xj_tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON text, a default where the text is malformed."""
    e = G.table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.substring("props", 1, 3))
    return e.select("event_id", W.json_field(raw, "k long", "k", F.lit(-1)).alias("k"))


@query("SELECT conv_id, turn, role AS type, count(*) AS n FROM conversations GROUP BY ALL")
def s20_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns emitted as nodes of the type of their role, all rejected by the parser, appended to an audit table and read back."""
    from ..operators.validation import parse_nodes
    from ..storage import materialise

    emitted = G.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("name"), F.col("role").alias("type"), F.lit(None).cast("string").alias("subtype"), F.lit(None).cast("map<string,string>").alias("properties"))
    rejected = materialise(parse_nodes(emitted).where(F.col("reason").isNotNull()), "audit")
    return rejected.groupBy("conv_id", "turn", "type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, count(*) AS n, round(avg(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))), 6) AS mean FROM embeddings GROUP BY label")
def v5_block_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of each block to one vector."""
    from ..functions.similarity import cosine

    e = G.table(spark, sf_dir, "embeddings")
    q = F.lit([float(x) for x in e.where("vec_id = 0").select("embedding").first()[0]])
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(cosine(F.col("embedding"), q)), 6).alias("mean"))
