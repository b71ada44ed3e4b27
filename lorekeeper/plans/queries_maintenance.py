"""Queries of validation, resolution, deduplication, review and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, resolution, validation, writes
from . import graph as G
from .registry import query

_TYPES = ["person", "task", "chunk", "alien", None, "fact", "event", "object", "preference", "location"]
_SUBS = [None, "individual", "city", "device"]
_EDGES = ["related_to", "todo", "experienced", "part_of", None, "likes", "related_to"]
_ENDS = ["person", "task", "event", None, "ghost", "location", "organization"]
_SEMS = [None, "knows", "occurred_at", "adores", "resides_at"]


def _pick(values: list, key: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values)).cast("int"))


def _pick_sql(values: list, key: str) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][({key}) % {len(values)} + 1]"


def _emitted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return G.table(spark, sf_dir, "customer").select(k.alias("id"), _pick(_TYPES, k).alias("type"), _pick(_SUBS, F.floor(k / 10)).alias("subtype"), F.when(k % 11 > 0, F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("name"))


_NODES_SQL = f"SELECT c_custkey AS id, {_pick_sql(_TYPES, 'c_custkey')} AS type, {_pick_sql(_SUBS, 'c_custkey // 10')} AS subtype, CASE WHEN c_custkey % 11 > 0 THEN '  ' || c_name || ' ' END AS name FROM customer"
_KNOWN = "('document', 'chunk', 'person', 'organization', 'location', 'event', 'object', 'preference', 'fact')"


@query(f"""WITH e AS ({_NODES_SQL}), k AS (SELECT id, type AS raw, CASE WHEN type = 'task' THEN 'object' ELSE type END AS type, CASE WHEN type = 'task' AND subtype IS NULL THEN 'task' ELSE subtype END AS subtype, trim(lower(coalesce(name, ''))) AS name FROM e)
SELECT id, type, subtype, name, CASE WHEN raw IS NULL THEN 'missing_type' WHEN type NOT IN {_KNOWN} THEN 'unknown_type' WHEN type IN ('document', 'chunk') THEN 'non_extractable_type' END AS reason FROM k""")
def d4_parse_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emitted nodes with the reason for which each is dropped."""
    return validation.parse_nodes(_emitted_nodes(spark, sf_dir)).select("id", "type", "subtype", "name", "reason")


@query(f"""WITH e AS ({_NODES_SQL}) SELECT id, CASE WHEN type IS NULL OR type NOT IN {_KNOWN} THEN 'unknown_type'
WHEN type NOT IN ('document', 'chunk') AND trim(coalesce(name, '')) = '' THEN 'missing_name'
WHEN type IN ('person', 'location', 'event', 'object') AND subtype IS NULL THEN 'missing_subtype'
WHEN type IN ('person', 'location', 'event', 'object') AND (type, subtype) NOT IN (('person', 'individual'), ('location', 'city'), ('object', 'device')) THEN 'unknown_subtype' END AS reason FROM e""")
def d5_node_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each node breaks."""
    return _emitted_nodes(spark, sf_dir).select("id", validation.node_reason().alias("reason"))


def _emitted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = G.table(spark, sf_dir, "orders").select(k.alias("id"), _pick(_EDGES, k).alias("type"), _pick(_ENDS, F.floor(k / 7)).alias("source_type"), _pick(_ENDS, F.floor(k / 49)).alias("target_type"), _pick(_SEMS, F.floor(k / 343)).alias("semantic_type"))
    return rows.withColumns({"source_node_id": F.lit(" A "), "target_node_id": F.lit("b")})


_EDGES_SQL = f"SELECT o_orderkey AS id, {_pick_sql(_EDGES, 'o_orderkey')} AS type, {_pick_sql(_ENDS, 'o_orderkey // 7')} AS s, {_pick_sql(_ENDS, 'o_orderkey // 49')} AS t, {_pick_sql(_SEMS, 'o_orderkey // 343')} AS sem FROM orders"
_SEM_PAIRS = """((sem = 'knows' AND s = 'person' AND t = 'person') OR (sem = 'occurred_at' AND s = 'event' AND t = 'location') OR (sem = 'resides_at' AND s = 'person' AND t = 'location')
 OR (sem = 'has_task' AND s = 'person' AND t = 'object') OR (sem = 'experienced_by' AND s = 'person' AND t = 'event'))"""


@query(f"""WITH e AS ({_EDGES_SQL}), k AS (SELECT id, type AS raw, CASE WHEN type IN ('todo', 'experienced') THEN 'related_to' ELSE type END AS type, CASE WHEN s = 'task' THEN 'object' ELSE s END AS s, CASE WHEN t = 'task' THEN 'object' ELSE t END AS t,
CASE type WHEN 'todo' THEN 'has_task' WHEN 'experienced' THEN 'experienced_by' ELSE sem END AS sem FROM e)
SELECT id, CASE WHEN raw IS NULL THEN 'missing_type' WHEN type NOT IN ('related_to', 'part_of') THEN 'unknown_type' WHEN type = 'part_of' THEN 'non_extractable_type' WHEN s IS NULL OR t IS NULL THEN 'missing_endpoint_type'
WHEN s = 'ghost' OR t = 'ghost' THEN 'invalid_endpoint_type' WHEN sem IS NULL THEN 'missing_semantic_type' WHEN sem = 'adores' THEN 'unknown_semantic' WHEN NOT {_SEM_PAIRS} THEN 'disallowed_pair' END AS reason FROM k""")
def d4_parse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emitted edges with the reason for which each is dropped."""
    return validation.parse_edges(_emitted_edges(spark, sf_dir)).select("id", "reason")


@query(f"""WITH e AS ({_EDGES_SQL}) SELECT id, CASE WHEN type IS NULL OR type NOT IN ('related_to', 'part_of') THEN 'unknown_type' WHEN s IS NULL OR t IS NULL THEN 'missing_endpoint_type'
WHEN type = 'related_to' AND sem IS NULL THEN 'missing_semantic_type' WHEN type = 'related_to' AND sem = 'adores' THEN 'unknown_semantic' WHEN type = 'related_to' AND NOT {_SEM_PAIRS} THEN 'disallowed_pair'
WHEN type = 'part_of' AND sem IS NOT NULL THEN 'semantic_on_non_related_to' WHEN type = 'part_of' THEN 'disallowed_pair' END AS reason FROM e""")
def d5_edge_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each edge breaks."""
    return _emitted_edges(spark, sf_dir).select("id", validation.edge_reason().alias("reason"))


@query("SELECT c_custkey AS id, 'colour' AS field, 'red' AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer WHERE c_custkey % 2 = 1")
def d6_dropped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties that a type does not know, one row each."""
    props = F.create_map(F.lit("colour"), F.lit("red"), F.lit("segment"), F.col("c_mktsegment"))
    rows = G.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "person").otherwise("event").alias("type"), props.alias("properties"))
    return validation.split_fields(rows, {"person": ["segment"], "event": []})[1].select("id", "field", "value")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 100 = 1 THEN 'self' ELSE lower(c_name) END AS name, CASE WHEN c_custkey % 100 = 1 THEN [lower(c_name)] ELSE [] END AS aliases FROM customer")
def d8_first_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People who are the tenant's user become ``self``."""
    people = G.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 100).alias("user_id"), F.lit("person").alias("type"), F.lower("c_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    users = people.where("user_id = 1").groupBy("user_id").agg(F.collect_list(F.lower("name")).alias("known"))
    return validation.redirect_first_person(people, users).select("id", "name", "aliases")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    one = p.select(F.lit("t").alias("user_id"), F.lit("object").alias("type"), F.concat(F.lit("object:"), "p_name").alias("id"), F.col("p_name").alias("name"), F.array(F.concat(F.lit("the "), "p_name")).alias("aliases"))
    return resolution.live_candidates(one)


@query("""WITH n AS (SELECT DISTINCT p_name FROM part)
SELECT 'up ' || p_name AS mention_id, 'object:' || p_name AS matched_id, 'exact' AS match_type, 1.0 AS confidence FROM n
UNION ALL SELECT 'the ' || p_name, 'object:' || p_name, 'alias', 1.0 FROM n UNION ALL SELECT 'odd ' || p_name, NULL, 'none', 0.0 FROM n""")
def d13_resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions by another case, by an alias, and of something else."""
    names = G.table(spark, sf_dir, "part").select("p_name").distinct()
    base = names.select("p_name", F.lit("t").alias("user_id"), F.lit("object").alias("type"))
    forms = [("up ", F.upper("p_name")), ("the ", F.concat(F.lit("The  "), "p_name")), ("odd ", F.concat(F.lit("zzzzqqqq "), F.reverse("p_name"), F.lit(" 0123456789")))]
    mentions = [base.select(F.concat(F.lit(k), "p_name").alias("mention_id"), "user_id", "type", v.alias("name")) for k, v in forms]
    return resolution.resolve(mentions[0].unionByName(mentions[1]).unionByName(mentions[2]), _parts(spark, sf_dir))


@query()
def d16_fuzzy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with a letter gone, matched by their sorted words."""
    names = G.table(spark, sf_dir, "part").select("p_name").distinct()
    cut = F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 100))
    mentions = names.select(F.col("p_name").alias("mention_id"), F.lit("t").alias("user_id"), F.lit("object").alias("type"), cut.alias("name"))
    return resolution.resolve(mentions, _parts(spark, sf_dir))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node a vector: id, user_id, type (its label), name, embedding and the rest that dedup reads."""
    e = G.table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("id"), F.lit("t").alias("user_id"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("type"),
        F.concat(F.lit("name "), F.col("vec_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"),
        F.when(F.col("vec_id") % 17 == 0, "gone").alias("merged_into"), "embedding", F.when(F.col("vec_id") % 4 == 0, F.lit("2024-02-01")).otherwise(F.lit("2024-01-01")).cast("timestamp").alias("updated_at"),
    )


_CONFIG = dedup.DedupConfig(merge=0.45, flag=0.35, use_fuzzy=False)
_DEDUP_SQL = """WITH n AS (SELECT 'v' || lpad(vec_id::VARCHAR, 6, '0') AS id, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT a.id AS left_id, a.vec_id AS lv, b.id AS right_id, b.vec_id AS rv, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM n a JOIN n b USING (label)),
"""
_TOP = """top AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS r FROM pairs QUALIFY r <= 10),
best AS (SELECT left_id, arg_max(right_id, (score, -r)) AS matched_id, max(score) AS score FROM top WHERE left_id <> right_id AND rv % 17 <> 0 AND score > 0 GROUP BY left_id)
"""


@query(_DEDUP_SQL + _TOP + """SELECT n.id AS left_id, CASE WHEN score >= 0.35 THEN matched_id END AS matched_id, CASE WHEN score >= 0.35 THEN score END AS score, CASE WHEN score >= 0.35 THEN 'embedding' END AS match_type,
CASE WHEN score >= 0.45 THEN 'merged' WHEN score >= 0.35 THEN 'flagged' ELSE 'none' END AS action FROM n LEFT JOIN best ON best.left_id = n.id""")
def d22_dedup_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge, flag or leave each node by its nearest others."""
    people = _people(spark, sf_dir)
    return dedup.decide(people, people, None, _CONFIG)


@query(_DEDUP_SQL.replace("FROM embeddings", "FROM embeddings WHERE vec_id % 17 <> 0") + _TOP + """, d AS (SELECT least(left_id, matched_id) AS low_id, greatest(left_id, matched_id) AS high_id, best.score FROM best JOIN n ON n.id = left_id WHERE vec_id % 4 = 0 AND best.score >= 0.35)
SELECT low_id, high_id, max(score) AS score, CASE WHEN max(score) >= 0.45 THEN 'merged' ELSE 'flagged' END AS action FROM d WHERE substr(low_id, 7, 1) <> '5' GROUP BY low_id, high_id""")
def d35_consolidation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of changed nodes with any nodes, those reviewed before left out."""
    people = _people(spark, sf_dir)
    done = dedup.decide(people.where("merged_into is null"), people.where("merged_into is null"), None, _CONFIG).where("action <> 'none'")
    done = dedup.ordered_pairs(done, "left_id", "matched_id").where(F.substring("low_id", 7, 1) == "5").select(F.col("high_id").alias("source_node_id"), F.col("low_id").alias("target_node_id"))
    return dedup.sweep(people, done, F.lit("2024-01-16").cast("timestamp"), _CONFIG, None).select("low_id", "high_id", "score", "action")


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("w"), k).alias("w_id"), F.array(F.lit("w")).alias("w_aliases"), F.array(F.lit("s1")).alias("w_sources"), F.lit(0.5).alias("w_confidence"), F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("yy")).alias("w_properties"),
        F.lower("c_name").alias("l_name"), F.array(F.lit("l"), F.lit("w")).alias("l_aliases"), F.array(F.lit("s2")).alias("l_sources"), (k % 10 / 10).alias("l_confidence"), F.create_map(F.lit("a"), F.col("c_mktsegment"), F.lit("c"), F.lit("z")).alias("l_properties"),
    )


@query("SELECT 'w' || c_custkey AS id, list_sort(['w', 'l', lower(c_name)]) AS aliases, ['s1', 's2'] AS sources, greatest(0.5, c_custkey % 10 / 10) AS confidence, c_mktsegment AS a, 'yy' AS b, 'z' AS c FROM customer")
def d26_merge_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners after merges: names and sources united, the longer property kept."""
    out = dedup.merge_nodes(_pair(spark, sf_dir))
    return out.select("id", "aliases", "sources", "confidence", *[F.element_at("properties", k).alias(k) for k in "abc"])


@query("SELECT 'w' || c_custkey AS id, list_sort(['w', 'l', lower(c_name)]) AS aliases, 0.5 AS confidence FROM customer")
def d27_keep_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners that take names and sources only."""
    return dedup.merge_nodes(_pair(spark, sf_dir), "keep_aliases").select("id", "aliases", F.col("confidence").cast("double").alias("confidence"))


@query("""SELECT o.o_orderkey AS id, CASE WHEN o.o_orderdate <> p.o_orderdate THEN o.o_orderdate < p.o_orderdate WHEN o.o_totalprice <> p.o_totalprice THEN o.o_totalprice > p.o_totalprice ELSE o.o_orderkey < p.o_orderkey END AS first_wins
FROM orders o JOIN orders p ON p.o_orderkey = o.o_orderkey + 1""")
def d32_winner_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two nodes wins: the older, the surer, the smaller id."""
    o = G.table(spark, sf_dir, "orders")
    side = lambda p: o.select(F.col("o_orderkey").alias(f"{p}_id"), F.col("o_orderdate").alias(f"{p}_created_at"), F.col("o_totalprice").alias(f"{p}_confidence"))
    pairs = side("a").join(side("b"), F.col("b_id") == F.col("a_id") + 1)
    return pairs.select(F.col("a_id").alias("id"), dedup.winner_first().alias("first_wins"))


@query("""WITH e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 1 THEN c_custkey - 1 ELSE c_custkey END AS s, c_nationkey AS t FROM customer)
SELECT 'p' || s || '|related_to|n' || t AS id, arg_min(k::VARCHAR, (k % 5 = 1)::INT) AS k FROM e GROUP BY s, t""")
def d33_transfer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of losers, given to their winners."""
    c = G.table(spark, sf_dir, "customer")
    source, target = F.concat(F.lit("p"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")
    edges = c.select(T.edge_id(source, F.lit("related_to"), target).alias("id"), F.lit("t").alias("user_id"), F.lit("related_to").alias("type"), F.lit("resides_at").alias("semantic_type"), source.alias("source_node_id"), F.lit("person").alias("source_type"), target.alias("target_node_id"), F.lit("location").alias("target_type"), F.create_map(F.lit("k"), F.col("c_custkey").cast("string")).alias("properties"))
    merged = c.where("c_custkey % 5 = 1").select(source.alias("loser_id"), F.concat(F.lit("p"), (F.col("c_custkey") - 1).cast("string")).alias("winner_id"))
    return dedup.transfer_edges(edges, merged).select("id", F.element_at("properties", "k").alias("k"))


def _same_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.table(spark, sf_dir, "customer")
    status = F.get(F.array(F.lit("pending"), F.lit("confirmed"), F.lit("rejected")), (F.col("c_custkey") % 3).cast("int"))
    return c.select(F.concat(F.lit("e"), "c_custkey").alias("id"), F.col("c_custkey").alias("source_node_id"), (F.col("c_custkey") + 1).alias("target_node_id"), F.create_map(F.lit("status"), status, F.lit("confidence"), (F.col("c_custkey") % 100 / 100).cast("string")).alias("properties"))


@query("""SELECT 'e' || a.c_custkey AS id, a.c_custkey % 100 / 100 AS confidence, lower(a.c_name) AS source_name, lower(b.c_name) AS target_name
FROM (SELECT * FROM customer WHERE c_custkey % 3 = 0 ORDER BY c_custkey % 100 DESC, 'e' || c_custkey LIMIT 25) a JOIN customer b ON b.c_custkey = a.c_custkey + 1""")
def d30_pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest pending pairs with both names."""
    nodes = G.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("name"), F.lit("person").alias("type"))
    return dedup.pending_reviews(_same_as(spark, sf_dir), nodes, 25).select("id", "confidence", "source_name", "target_name")


@query("SELECT least(c_custkey, c_custkey + 1) AS low_id, c_custkey + 1 AS high_id FROM customer WHERE c_custkey % 3 = 2")
def j2_rejected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that reviewers have rejected."""
    return dedup.rejected_pairs(_same_as(spark, sf_dir))


@query("SELECT 'e' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 0.9 ELSE 0.1 END AS score, CASE WHEN c_custkey < 50 THEN 'confirmed' ELSE 'pending' END AS status FROM customer WHERE c_custkey % 2 = 0 OR c_custkey < 50")
def d28_upsert_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores refreshed, states kept."""
    c = G.table(spark, sf_dir, "customer").select(F.concat(F.lit("e"), "c_custkey").alias("id"), "c_custkey")
    now = F.lit("2024-01-01").cast("timestamp").alias("created_at")
    current = c.where("c_custkey < 50").select("id", F.lit(0.1).alias("score"), F.lit("confirmed").alias("status"), now)
    incoming = c.where("c_custkey % 2 = 0").select("id", F.lit(0.9).alias("score"), now)
    return dedup.upsert_pending(current, incoming).select("id", F.col("score").cast("double").alias("score"), "status")


@query("""SELECT 'p' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'old' END AS segment, CASE WHEN c_custkey < 100 THEN 'yes' END AS old, list_sort(list_distinct(list_concat(CASE WHEN c_custkey < 100 THEN ['s0'] ELSE [] END, CASE WHEN c_custkey % 2 = 0 THEN ['s1', 's2'] ELSE [] END))) AS sources,
CASE WHEN c_custkey < 100 THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '2024-01-01' END AS created_at FROM customer WHERE c_custkey < 100 OR c_custkey % 2 = 0""")
def g2_upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes after an upsert with two rows for each id."""
    c = G.table(spark, sf_dir, "customer").withColumn("id", F.concat(F.lit("p"), "c_custkey"))
    old = F.lit("2020-01-01").cast("timestamp")
    current = c.where("c_custkey < 100").select("id", "c_name", F.lit("n").alias("name"), F.create_map(F.lit("segment"), F.lit("old"), F.lit("old"), F.lit("yes")).alias("properties"), F.array(F.lit("a")).alias("aliases"), F.array(F.lit("s0")).alias("sources"), old.alias("created_at"), old.alias("updated_at")).drop("c_name")
    row = lambda seq, value: c.where("c_custkey % 2 = 0").select("id", F.lit("n").alias("name"), F.create_map(F.lit("segment"), value).alias("properties"), F.array(F.lit("a")).alias("aliases"), F.array(F.lit(f"s{seq}")).alias("sources"), F.lit(seq).alias("seq"))
    out = writes.upsert_nodes(current, row(1, F.lit("first")).unionByName(row(2, F.col("c_mktsegment"))), F.lit("2024-01-01").cast("timestamp"))
    return out.select("id", F.element_at("properties", "segment").alias("segment"), F.element_at("properties", "old").alias("old"), "sources", "created_at")


@query("SELECT doc_id::VARCHAR AS source_uri, CASE WHEN doc_id % 2 = 1 THEN 'kept' WHEN doc_id % 3 = 2 THEN 'inserted' WHEN doc_id % 3 = 0 THEN 'replaced' ELSE 'skipped' END AS outcome FROM documents WHERE NOT (doc_id % 2 = 1 AND doc_id % 3 = 2)")
def s17_upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after an ingest, with what became of each."""
    d = G.table(spark, sf_dir, "documents").select("doc_id", F.lit("t").alias("user_id"), F.col("doc_id").cast("string").alias("source_uri"))
    current = d.where("doc_id % 3 <> 2").select("user_id", "source_uri", F.when(F.col("doc_id") % 3 == 0, "latent").otherwise("web").alias("source_type"), F.lit("old").alias("title"))
    incoming = d.where("doc_id % 2 = 0").select("user_id", "source_uri", F.lit("web").alias("source_type"), F.lit("new").alias("title"))
    return writes.upsert_documents(current, incoming).select("source_uri", "outcome")


@query("SELECT DISTINCT (doc_id + 900)::VARCHAR AS source_uri FROM documents WHERE doc_id + 900 NOT IN (SELECT doc_id FROM documents)")
def s18_latent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders for references to documents that are not there."""
    d = G.table(spark, sf_dir, "documents")
    refs = d.select(F.lit("t").alias("user_id"), (F.col("doc_id") + 900).cast("string").alias("source_uri"))
    return writes.latent_documents(refs, d.select(F.lit("t").alias("user_id"), F.col("doc_id").cast("string").alias("source_uri"))).select("source_uri")


@query("SELECT o_custkey AS id, arg_max(o_orderkey, o_orderkey) AS last FROM orders GROUP BY o_custkey")
def g3_edge_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an id, the last."""
    o = G.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("last"))
    return dedup.edge_collapse(o, "last")


@query("SELECT l_orderkey, arg_max(l_partkey, (l_extendedprice, -l_linenumber)) AS best FROM lineitem GROUP BY l_orderkey")
def g4_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scored candidate, the earlier one among equals."""
    l = G.table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_extendedprice", (-F.col("l_linenumber")).alias("x"))).alias("best"))


@query("SELECT o_custkey AS id, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def w5_capped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three rows of each key in a fixed order."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return G.table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select(F.col("o_custkey").alias("id"), "o_orderkey")


@query("SELECT 't' || (user_id % 3) AS user_id, event_type AS job, max(ts) AS last_run_at FROM events GROUP BY ALL")
def d38_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start of the last run of each tenant's job."""
    e = G.table(spark, sf_dir, "events").select(G.tenant(F.col("user_id")).alias("user_id"), F.col("event_type").alias("job"), F.col("ts").cast("timestamp").alias("started_at"))
    states = e.where("started_at < '2024-01-16'").withColumnRenamed("started_at", "last_run_at")
    return writes.record_run(states, e)
