"""From extracted rows to the graph's tables: extraction, validation, resolution and writes as stages.

Emitted nodes have user_id, source_uri, seq (their order), type, subtype, name and
properties; emitted edges have user_id, source_uri, seq, type, semantic_type,
source_type, source_name, target_type, target_name and properties.  Names are what the
text says; ids are made from them here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ontology import ONTOLOGY, Ontology
from ..functions.text import capped_union, edge_id, node_id, normalize_name, per_key_merge, slugify, typed_embedding_text
from ..storage import materialise
from . import dedup, resolution, validation
from .grouping import first_values, merged_properties, shuffled
from .chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_texts

#: text -> (nodes, edges), each a dict with the fields that the model found.
Extractor = Callable[[str], tuple[list[dict], list[dict]]]

_FIELDS = ("type", "subtype", "semantic_type", "name", "source_type", "source_name", "target_type", "target_name")
_STRINGS = "map<string,string>"
_STRUCTURAL = ("document", "chunk")
NODE_COLUMNS = ("id", "user_id", "type", "subtype", "name", "canonical_name", "aliases", "sources", "properties", "confidence", "embedding", "merged_into", "created_at", "updated_at")
EDGE_COLUMNS = ("id", "user_id", "type", "semantic_type", "source_node_id", "source_type", "target_node_id", "target_type", "properties", "sources", "created_at", "updated_at")


def extract(chunks: DataFrame, extractor: Extractor) -> DataFrame:
    """One row for each node and edge that the extractor finds in a chunk, ``kind`` node, edge or failed.

    ``chunks`` has user_id, source_uri, seq and text.  A call that fails gives one row with
    the error as its name, and the other chunks go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for user, uri, seq, text in zip(batch["user_id"], batch["source_uri"], batch["seq"], batch["text"], strict=True):
                try:
                    nodes, edges = extractor(text or "")
                    found = [("node", x) for x in nodes] + [("edge", x) for x in edges]
                    made = [(user, uri, seq, kind, *[x.get(f) for f in _FIELDS], {k: str(v) for k, v in (x.get("properties") or {}).items() if v is not None}) for kind, x in found]
                except Exception as e:  # a model's failure is a row, not the end of the job
                    made = [(user, uri, seq, "failed", *[None] * 3, str(e), *[None] * 4, {})]
                rows += made
            yield pd.DataFrame(rows, columns=["user_id", "source_uri", "seq", "kind", *_FIELDS, "properties"])

    schema = "user_id string, source_uri string, seq long, kind string, " + ", ".join(f"{f} string" for f in _FIELDS) + f", properties {_STRINGS}"
    return chunks.select("user_id", "source_uri", F.col("seq").cast("long").alias("seq"), "text").mapInPandas(run, schema)


@dataclass(frozen=True)
class Validated:
    """What validation keeps, and an audit row for each row or property that it does not."""

    nodes: DataFrame
    edges: DataFrame
    rejected: DataFrame
    dropped: DataFrame


_AUDIT = ("user_id", "source_uri", "seq", "kind", "id", "type", "field", "value", "reason")


def validate(nodes: DataFrame, edges: DataFrame, allowed: dict[str, list[str]] | None = None, ontology: Ontology = ONTOLOGY) -> Validated:
    """Parse and check emitted rows.  The first rule that a row breaks is its reason.

    A property that the registered schema of a node or edge does not take is dropped, with an
    audit row and its reason, and the row stays.  ``allowed`` (type to its property names)
    takes the place of the schemas of nodes.
    """
    parsed = validation.parse_nodes(nodes, ontology)
    parsed = parsed.withColumn("reason", F.coalesce("reason", validation.node_reason(ontology)))
    ends = edges.withColumns({"source_node_id": F.col("source_name"), "target_node_id": F.col("target_name")})
    linked = validation.parse_edges(ends, ontology)
    unnamed = F.when((F.col("source_node_id") == "") | (F.col("target_node_id") == ""), "missing_endpoint_name")
    linked = linked.withColumns({"reason": F.coalesce("reason", validation.edge_reason(ontology), unnamed), "source_name": F.col("source_node_id"), "target_name": F.col("target_node_id")})
    linked = linked.drop("source_node_id", "target_node_id")
    audit = lambda df, kind, name: df.where("reason is not null").select("user_id", "source_uri", "seq", F.lit(kind).alias("kind"), "type", name.alias("name"), "reason")
    rejected = audit(parsed, "node", F.col("name")).unionByName(audit(linked, "edge", F.concat_ws("|", "source_name", "target_name")))
    kept = parsed.where("reason is null").drop("reason").withColumn("id", own_id(F.col("user_id"), F.col("type"), F.col("name")))
    good = linked.where("reason is null").drop("reason").withColumn("id", edge_id(*_ends()))
    if allowed is None:
        kept, lost = validation.split_schema(kept, ontology)
    else:
        kept, lost = validation.split_fields(kept, allowed)
        lost = lost.withColumn("reason", F.lit("unknown_field"))
    good, unknown = validation.split_schema(good, ontology, edges=True)
    dropped = lost.withColumn("kind", F.lit("node")).unionByName(unknown.withColumn("kind", F.lit("edge")))
    return Validated(kept.drop("id"), good.drop("id"), rejected, dropped.select(*_AUDIT))


def _ends() -> tuple[Column, Column, Column]:
    """Both ends of an emitted edge as ids, its type between them."""
    source, target = (own_id(F.col("user_id"), F.col(f"{e}_type"), F.col(f"{e}_name")) for e in ("source", "target"))
    return source, F.col("type"), target


def own_id(user: Column, kind: Column, name: Column) -> Column:
    """The id of a name: normalised, but for documents and chunks, whose names are uris."""
    return node_id(user, kind, F.when(kind.isin(*_STRUCTURAL), name).otherwise(normalize_name(name)))


def collapse_nodes(emitted: DataFrame) -> DataFrame:
    """One row an id: the last row's name and subtype, the last value of each property, at most 500 sources."""
    rows = emitted.withColumn("id", own_id(F.col("user_id"), F.col("type"), F.col("name")))
    last = F.struct("seq", "source_uri", "name")
    firsts = [F.max_by(c, last).alias(c) for c in ("user_id", "type", "name")] + [F.max_by("subtype", F.when(F.col("subtype").isNotNull(), last)).alias("subtype")]
    if "embedding" in emitted.columns:
        firsts.append(F.max_by("embedding", F.when(F.col("embedding").isNotNull(), last)).alias("embedding"))
    out = rows.groupBy("id").agg(*firsts)
    out = out.join(merged_properties(rows, "id", F.struct("seq", "value")), "id", "left").join(first_values(rows, "id", F.col("source_uri"), dedup.MAX_SOURCES, "sources"), "id", "left")
    empty = {"properties": F.create_map().cast(_STRINGS), "sources": F.array().cast("array<string>")}
    if "aliases" in emitted.columns:
        names = rows.select("id", F.explode("aliases").alias("alias"))
        out = out.join(first_values(names, "id", F.col("alias"), dedup.MAX_ALIASES, "aliases"), "id", "left")
        empty["aliases"] = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, v) for c, v in empty.items()})


def resolve_nodes(collapsed: DataFrame, nodes: DataFrame, semantic: bool = False) -> DataFrame:
    """The collapsed rows with canonical_name, match_type and confidence from the tenant's live nodes of their type.

    Documents and chunks are what their uris say and are not resolved.
    """
    alive = nodes.where((F.coalesce("merged_into", F.lit("")) == "") & ~F.col("type").isin(*_STRUCTURAL))
    mentions = collapsed.where(~F.col("type").isin(*_STRUCTURAL)).withColumnRenamed("id", "mention_id")
    found = resolution.resolve(mentions, alive, semantic).withColumnRenamed("mention_id", "id")
    names = alive.select(F.col("id").alias("matched_id"), F.coalesce("canonical_name", "name").alias("__canonical"))
    found = found.join(shuffled(names), "matched_id", "left").select("id", "matched_id", "match_type", F.when(F.col("match_type") == "none", 1.0).otherwise(F.col("confidence")).alias("confidence"), "__canonical")
    filled = {"canonical_name": F.coalesce("__canonical", "name"), "match_type": F.coalesce("match_type", F.lit("none")), "confidence": F.coalesce("confidence", F.lit(1.0))}
    return collapsed.join(shuffled(found), "id", "left").withColumns(filled).drop("__canonical")


def _upsert_new(nodes: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Nodes after rows came in under their own ids: what came wins in properties, creation and aliases stay."""
    new = rows.select("id", *[F.col(c).alias(f"n_{c}") for c in NODE_COLUMNS if c in rows.columns and c != "id"])
    both = nodes.select(*NODE_COLUMNS).join(new, "id", "full_outer")
    came = F.col("n_user_id").isNotNull()
    none = F.create_map().cast(_STRINGS)
    old, add = F.coalesce("properties", none), F.coalesce("n_properties", none)
    out = {c: F.coalesce(f"n_{c}", c) for c in ("user_id", "type", "subtype", "name", "canonical_name", "confidence", "embedding")}
    out |= {
        "properties": F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(add, k)), add),
        "aliases": capped_union(F.col("aliases"), F.col("n_aliases"), dedup.MAX_ALIASES) if "aliases" in rows.columns else F.coalesce("aliases", F.array().cast("array<string>")),
        "sources": capped_union(F.col("sources"), F.col("n_sources"), dedup.MAX_SOURCES),
        "created_at": F.coalesce("created_at", F.when(came & F.col("user_id").isNull(), now)),
        "updated_at": F.when(came, now).otherwise(F.col("updated_at")),
    }
    return both.select("id", *[out.get(c, F.col(c)).alias(c) for c in NODE_COLUMNS if c != "id"])


def _merge_into(nodes: DataFrame, rows: DataFrame, strategy: str, now: Column) -> DataFrame:
    """Nodes after rows were merged into their ``target_id``: names, sources and what the strategy says."""
    if strategy not in ("keep_primary", "merge_properties", "keep_aliases"):
        raise ValueError(strategy)
    new = first_values(rows, "target_id", F.col("name"), dedup.MAX_ALIASES, "n_aliases")
    sources = rows.select("target_id", F.explode("sources").alias("source"))
    new = new.join(first_values(sources, "target_id", F.col("source"), dedup.MAX_SOURCES, "n_sources"), "target_id", "left")
    values = rows.select("target_id", F.lit(0).alias("seq"), "properties")
    new = new.join(merged_properties(values, "target_id", F.struct(F.length("value"), "value")).withColumnRenamed("properties", "n_properties"), "target_id", "left")
    out = nodes.join(shuffled(new.withColumnRenamed("target_id", "id")), "id", "left")
    came = F.col("n_aliases").isNotNull()
    none = F.create_map().cast(_STRINGS)
    changed = {
        "aliases": capped_union(F.col("aliases"), F.filter("n_aliases", lambda x: x != F.col("name")), dedup.MAX_ALIASES),
        "sources": capped_union(F.col("sources"), F.col("n_sources"), dedup.MAX_SOURCES),
        "updated_at": now,
    }
    if strategy == "merge_properties":
        changed["properties"] = per_key_merge(F.coalesce("properties", none), F.coalesce("n_properties", none))
    return out.withColumns({c: F.when(came, v).otherwise(F.col(c)) for c, v in changed.items()}).select(*nodes.columns)


def upsert_edges(edges: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Edges after an upsert of ``incoming`` (the columns of edges but dates, and source_uri and seq).

    Rows of one id collapse to the last; its properties go over those that were there, and
    creation stays.  A review's status is not overwritten by a later score.
    """
    last = F.struct("seq", "source_uri", F.coalesce("semantic_type", F.lit("")))
    fields = ("user_id", "type", "semantic_type", "source_node_id", "source_type", "target_node_id", "target_type")
    new = incoming.groupBy("id").agg(*[F.max_by(c, last).alias(f"n_{c}") for c in fields])
    new = new.join(merged_properties(incoming, "id", F.struct("seq", "value")).withColumnRenamed("properties", "n_properties"), "id", "left")
    new = new.join(first_values(incoming, "id", F.col("source_uri"), dedup.MAX_SOURCES, "n_sources"), "id", "left")
    both = edges.select(*EDGE_COLUMNS).join(new, "id", "full_outer")
    came, none = F.col("n_user_id").isNotNull(), F.create_map().cast(_STRINGS)
    old, add = F.coalesce("properties", none), F.coalesce("n_properties", none)
    add = F.map_filter(add, lambda k, _: ~((F.coalesce("type", F.lit("")) == "same_as") & (k == "status") & F.map_contains_key(old, k)))
    out = {c: F.coalesce(f"n_{c}", c) for c in fields}
    out |= {
        "properties": F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(add, k)), add),
        "sources": capped_union(F.col("sources"), F.col("n_sources"), dedup.MAX_SOURCES),
        "created_at": F.when(F.col("user_id").isNull(), now).otherwise(F.col("created_at")),
        "updated_at": F.when(came, now).otherwise(F.col("updated_at")),
    }
    return both.select("id", *[out[c].alias(c) for c in EDGE_COLUMNS if c != "id"])


def mention_edges(emitted: DataFrame) -> DataFrame:
    """A ``mentions`` edge, by names, from each source document to each person that it names."""
    people = emitted.where("type = 'person'").groupBy("user_id", "source_uri", normalize_name(F.col("name")).alias("target_name")).agg(F.max("seq").alias("seq"))
    return people.select(
        "user_id", "source_uri", "seq", F.lit("mentions").alias("type"), F.lit(None).cast("string").alias("semantic_type"), F.lit("document").alias("source_type"), F.col("source_uri").alias("source_name"),
        F.lit("person").alias("target_type"), "target_name", F.create_map().cast(_STRINGS).alias("properties"),
    )


def apply_writes(
    nodes: DataFrame,
    edges: DataFrame,
    new_nodes: DataFrame,
    new_edges: DataFrame,
    now: Column,
    config: dedup.DedupConfig | None = None,
    strategy: str = "merge_properties",
    embed: Callable[[list[str]], list[list[float]]] | None = None,
    semantic: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph's nodes and edges after valid emitted rows came in, and the decision on each node.

    Emitted rows collapse by id, are resolved against the live nodes and, with a dedup
    ``config``, compared with them.  Those to merge go into the node that they match, all
    others are upserted under their own id; flagged ones get a pending same_as edge.  Edges
    follow their ends to the nodes that they went to, self-loops are left out and rows of one
    id collapse.  Structural rows may be among both inputs.  A second run with the same
    ``now`` changes nothing.
    """
    # Written: each column that collapses reads the rows, and so do the mentions.
    new_nodes = materialise(new_nodes, "rows")
    rows = collapse_nodes(new_nodes)
    if embed is not None:
        vector = F.pandas_udf(lambda s: pd.Series(list(embed(s.tolist()))), "array<double>")
        rows = rows.withColumn("embedding", vector(typed_embedding_text(F.col("type"), F.col("name"), F.col("properties"))))
    elif "embedding" not in rows.columns:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<double>"))
    # Written: resolution, comparison, nodes and edges all read these rows.
    rows = materialise(resolve_nodes(materialise(rows, "collapsed"), nodes, semantic), "resolved")
    if config is None:
        decided = rows.withColumns({"action": F.lit("none"), "target_id": F.col("id"), "score": F.lit(None).cast("double"), "kind": F.lit(None).cast("string")})
    else:
        known = F.col("aliases") if "aliases" in rows.columns else F.array().cast("array<string>")
        asked = rows.withColumns({"aliases": known, "merged_into": F.lit(None).cast("string")})
        same = edges.where("type = 'same_as'")
        choice = dedup.decide(asked, nodes, same, config).select(F.col("left_id").alias("id"), F.col("matched_id").alias("near_id"), "score", F.col("match_type").alias("kind"), "action")
        decided = rows.join(shuffled(choice), "id").withColumn("target_id", F.when(F.col("action") == "merged", F.col("near_id")).otherwise(F.col("id")))
        decided = materialise(decided, "decided")
    merged = decided.where("action = 'merged'")
    out = _upsert_new(nodes, decided.where("action <> 'merged'"), now)
    links = new_edges.unionByName(mention_edges(new_nodes))
    ends = {f"{e}_node_id": own_id(F.col("user_id"), F.col(f"{e}_type"), F.col(f"{e}_name")) for e in ("source", "target")}
    links = links.withColumns(ends)
    if config is not None:
        out = _merge_into(out, merged, strategy, now)
    links = resolution.remap_endpoints(links, merged.select(F.col("id").alias("built_id"), F.col("target_id").alias("node_id")))
    links = links.withColumn("id", edge_id(F.col("source_node_id"), F.col("type"), F.col("target_node_id"))).select("source_uri", "seq", *EDGE_COLUMNS[:-3])
    if config is not None:
        text = lambda k, v: (F.lit(k), v.cast("string"))
        state = F.create_map(*text("status", F.lit("pending")), *text("confidence", F.col("score")), *text("match_type", F.col("kind")))
        flagged = decided.where("action = 'flagged'").select(
            F.lit(None).cast("string").alias("source_uri"), F.lit(0).cast("long").alias("seq"), edge_id(F.col("id"), F.lit("same_as"), F.col("near_id")).alias("id"), "user_id", F.lit("same_as").alias("type"),
            F.lit(None).cast("string").alias("semantic_type"), F.col("id").alias("source_node_id"), F.col("type").alias("source_type"), F.col("near_id").alias("target_node_id"), F.col("type").alias("target_type"), state.alias("properties"),
        )
        links = links.unionByName(flagged)
    return out, upsert_edges(edges, links, now), decided.select("id", "target_id", "action", "match_type", "score")


@dataclass(frozen=True)
class Ingested:
    """The tables after documents came in, the audit rows, and what was decided on each node."""

    nodes: DataFrame
    edges: DataFrame
    rejected: DataFrame
    dropped: DataFrame
    failed: DataFrame
    decisions: DataFrame


def structural_rows(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Emitted nodes and edges of documents and chunks: each chunk is part of its document and follows the one before."""
    text = lambda x: F.lit(x).cast("string")
    chunk = F.concat("source_uri", F.lit("#chunk-"), "seq")
    node = lambda kind, name, props: (F.lit(kind).alias("type"), text(None).alias("subtype"), name.alias("name"), props.cast(_STRINGS).alias("properties"))
    documents = pieces.groupBy("user_id", "source_uri").agg(F.min("seq").alias("seq")).select("user_id", "source_uri", "seq", *node("document", F.col("source_uri"), F.create_map(text("source_uri"), F.col("source_uri"))))
    parts = pieces.select("user_id", "source_uri", "seq", *node("chunk", chunk, F.create_map(text("content"), F.col("text"))))

    def link(rows: DataFrame, kind: str, source: Column, target: tuple[str, Column]) -> DataFrame:
        return rows.select(
            "user_id", "source_uri", "seq", F.lit(kind).alias("type"), text(None).alias("semantic_type"), F.lit("chunk").alias("source_type"), source.alias("source_name"),
            F.lit(target[0]).alias("target_type"), target[1].alias("target_name"), F.create_map().cast(_STRINGS).alias("properties"),
        )

    before = F.concat("source_uri", F.lit("#chunk-"), F.col("seq") - 1)
    links = link(pieces, "part_of", chunk, ("document", F.col("source_uri"))).unionByName(link(pieces.where("seq > 0"), "next", before, ("chunk", chunk)))
    return documents.unionByName(parts), links


def _redirected(nodes: DataFrame, edges: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People of a tenant's own names become ``self`` in nodes and in the ends of edges."""
    nodes = validation.redirect_first_person(nodes, users)
    rows = edges.join(users.select("user_id", F.filter("known", lambda x: F.trim(x) != "").alias("__known")), "user_id", "left")
    for end in ("source", "target"):
        me = (F.col(f"{end}_type") == "person") & F.coalesce(F.array_contains("__known", F.lower(F.trim(f"{end}_name"))), F.lit(False))
        rows = rows.withColumn(f"{end}_name", F.when(me, "self").otherwise(F.col(f"{end}_name")))
    return nodes, rows.drop("__known")


def _own_preferences(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with preferences named by their statements, the tenants' own people, and an edge from these to each preference."""
    slug = F.nullif(slugify(F.element_at("properties", "statement")), F.lit(""))
    nodes = nodes.withColumn("name", F.when(F.col("type") == "preference", F.coalesce(slug, "name")).otherwise(F.col("name")))
    held = nodes.where("type = 'preference'").groupBy("user_id", "source_uri", "name").agg(F.max("seq").alias("seq"))
    me = held.groupBy("user_id", "source_uri").agg(F.max("seq").alias("seq")).select("user_id", "source_uri", "seq", F.lit("person").alias("type"), F.lit("individual").alias("subtype"), F.lit("self").alias("name"), F.create_map().cast(_STRINGS).alias("properties"))
    links = held.select(
        "user_id", "source_uri", "seq", F.lit("has").alias("type"), F.lit(None).cast("string").alias("semantic_type"), F.lit("person").alias("source_type"), F.lit("self").alias("source_name"),
        F.lit("preference").alias("target_type"), F.col("name").alias("target_name"), F.create_map().cast(_STRINGS).alias("properties"),
    )
    return nodes, me, links


def ingest_documents(
    documents: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    extractor: Extractor,
    now: Column,
    users: DataFrame | None = None,
    config: dedup.DedupConfig | None = None,
    strategy: str = "merge_properties",
    embed: Callable[[list[str]], list[list[float]]] | None = None,
    semantic: bool = False,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    encode: Callable[[str], list[int]] | None = None,
    decode: Callable[[list[int]], str] | None = None,
    ontology: Ontology = ONTOLOGY,
) -> Ingested:
    """The whole write path: chunks, extraction, validation, own names, resolution, vectors, comparison, writes.

    ``documents`` has user_id, source_uri and content; those without words are left out.
    ``users`` has a row a tenant: user_id and known (its own names in lower case).  Each
    chunk is given to the extractor once and its answer written; a failed call is a row of
    ``failed``.  Preferences are named by their statements and held by the tenant's ``self``.
    The same documents with the same ``now`` change nothing the second time.
    """
    pieces = chunk_texts(documents.select("user_id", "source_uri", "content"), ["user_id", "source_uri"], "content", size, overlap, encode, decode)
    pieces = materialise(pieces.withColumnRenamed("chunk_index", "seq"), "chunks")
    emitted = materialise(extract(pieces, extractor), "emitted")
    fields = ["user_id", "source_uri", "seq"]
    new_nodes = emitted.where("kind = 'node'").select(*fields, "type", "subtype", "name", "properties")
    new_edges = emitted.where("kind = 'edge'").select(*fields, "type", "semantic_type", "source_type", "source_name", "target_type", "target_name", "properties")
    found = validate(new_nodes, new_edges, None, ontology)
    named, links = found.nodes.withColumn("aliases", F.array().cast("array<string>")), found.edges
    if users is not None:
        named, links = _redirected(named, links, users)
    named, me, holds = _own_preferences(named)
    parts, joins = structural_rows(pieces)
    every = named.unionByName(me, allowMissingColumns=True).unionByName(parts, allowMissingColumns=True)
    out, out_edges, decisions = apply_writes(nodes, edges, every, links.unionByName(holds).unionByName(joins), now, config, strategy, embed, semantic)
    failed = emitted.where("kind = 'failed'").select(*fields, F.col("name").alias("error"))
    return Ingested(out, out_edges, found.rejected, found.dropped, failed, decisions)
