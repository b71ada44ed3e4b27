"""Parsing and validation of extracted rows, with a reason for each that is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ontology import ONTOLOGY, Ontology

# Older names and what they are now.
LEGACY_NODES = {"task": ("object", "task")}
LEGACY_EDGES = {"todo": "has_task", "experienced": "experienced_by"}


def _clean(name: Column) -> Column:
    return F.trim(F.lower(F.coalesce(name, F.lit(""))))


def _pairs(spec: dict[str, tuple[tuple[str, str], ...]], kind: Column, source: Column, target: Column) -> Column:
    """Whether the pair is one of the kind's, as a lookup in a literal map."""
    keys = sorted(f"{k}|{s}|{t}" for k, pairs in spec.items() for s, t in pairs)
    return F.concat_ws("|", kind, source, target).isin(*keys)


def parse_nodes(rows: DataFrame, ontology: Ontology = ONTOLOGY) -> DataFrame:
    """Emitted nodes with older types rewritten, names cleaned, and ``reason`` set where the row is dropped."""
    extractable = [t for t, (_, x) in ontology.nodes.items() if x]
    kind = F.col("type")
    for old, (new, _) in LEGACY_NODES.items():
        kind = F.when(F.col("type") == old, F.lit(new)).otherwise(kind)
    subtype = F.col("subtype")
    for old, (_, derived) in LEGACY_NODES.items():
        subtype = F.when((F.col("type") == old) & F.col("subtype").isNull(), F.lit(derived)).otherwise(subtype)
    reason = (
        F.when(F.col("type").isNull(), "missing_type")
        .when(~kind.isin(*ontology.nodes), "unknown_type")
        .when(~kind.isin(*extractable), "non_extractable_type")
    )
    return rows.withColumns({"name": _clean(F.col("name")), "reason": reason, "type": kind, "subtype": subtype})


def parse_edges(rows: DataFrame, ontology: Ontology = ONTOLOGY) -> DataFrame:
    """Emitted edges with older types rewritten, ends cleaned, and ``reason`` set where the row is dropped."""
    extractable = [t for t, (_, x) in ontology.edges.items() if x]
    legacy = F.element_at(F.create_map(*[F.lit(x) for kv in LEGACY_EDGES.items() for x in kv]), F.coalesce("type", F.lit("")))
    kind = F.when(legacy.isNotNull(), F.lit("related_to")).otherwise(F.col("type"))
    ends = {c: F.when(F.col(c) == "task", F.lit("object")).otherwise(F.col(c)) for c in ("source_type", "target_type")}
    source, target = ends["source_type"], ends["target_type"]
    semantic = F.coalesce(legacy, F.nullif(F.col("semantic_type"), F.lit("")))
    related = kind == "related_to"
    reason = (
        F.when(F.col("type").isNull(), "missing_type")
        .when(~kind.isin(*ontology.edges), "unknown_type")
        .when(~kind.isin(*extractable), "non_extractable_type")
        .when(source.isNull() | target.isNull(), "missing_endpoint_type")
        .when(~(source.isin(*ontology.nodes) & target.isin(*ontology.nodes)), "invalid_endpoint_type")
        .when(related & semantic.isNull(), "missing_semantic_type")
        .when(related & ~semantic.isin(*ontology.semantics), "unknown_semantic")
        .when(related & ~_pairs(ontology.semantics, semantic, source, target), "disallowed_pair")
        .when(~related & ~_pairs({k: p for k, (p, _) in ontology.edges.items()}, kind, source, target), "disallowed_pair")
    )
    return rows.withColumns(
        {"source_node_id": _clean(F.col("source_node_id")), "target_node_id": _clean(F.col("target_node_id")), "reason": reason, "type": kind, **ends, "semantic_type": F.when(related, semantic)}
    )


def node_reason(ontology: Ontology = ONTOLOGY) -> Column:
    """The first rule that a node breaks, or null."""
    extractable = [t for t, (_, x) in ontology.nodes.items() if x]
    closed = [t for t, (subs, x) in ontology.nodes.items() if x and subs]
    known = [f"{t}|{s}" for t, (subs, _) in ontology.nodes.items() for s in subs]
    kind, name, subtype = F.col("type"), F.col("name"), F.col("subtype")
    return (
        F.when(kind.isNull() | ~kind.isin(*ontology.nodes), "unknown_type")
        .when(kind.isin(*extractable) & (F.trim(F.coalesce(name, F.lit(""))) == ""), "missing_name")
        .when(kind.isin(*closed) & subtype.isNull(), "missing_subtype")
        .when(kind.isin(*closed) & ~F.concat_ws("|", kind, subtype).isin(*known), "unknown_subtype")
    )


def edge_reason(ontology: Ontology = ONTOLOGY) -> Column:
    """The first rule that an edge breaks, or null."""
    kind, source, target, semantic = F.col("type"), F.col("source_type"), F.col("target_type"), F.col("semantic_type")
    related = kind == "related_to"
    fact = F.coalesce(source == "fact", F.lit(False)) | F.coalesce(target == "fact", F.lit(False))
    return (
        F.when(kind.isNull() | ~kind.isin(*ontology.edges), "unknown_type")
        .when(fact, "fact_endpoint_disallowed")
        .when(source.isNull() | target.isNull(), "missing_endpoint_type")
        .when(related & semantic.isNull(), "missing_semantic_type")
        .when(related & ~semantic.isin(*ontology.semantics), "unknown_semantic")
        .when(related & ~_pairs(ontology.semantics, semantic, source, target), "disallowed_pair")
        .when(~related & semantic.isNotNull(), "semantic_on_non_related_to")
        .when(~related & ~_pairs({k: p for k, (p, _) in ontology.edges.items()}, kind, source, target), "disallowed_pair")
    )


def _where(rows: DataFrame) -> list[str]:
    """The columns that say where a row was emitted, as far as it has them."""
    return [c for c in ("user_id", "source_uri", "seq") if c in rows.columns]


def split_fields(rows: DataFrame, allowed: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Rows with the properties that their type knows, and a row for each key that was dropped."""
    known = F.array(*[F.lit(f"{t}|{k}") for t, ks in sorted(allowed.items()) for k in ks])
    fits = lambda k, _: F.array_contains(known, F.concat_ws("|", F.col("type"), k))
    kept = rows.withColumn("properties", F.map_filter("properties", fits))
    gone = F.map_entries(F.map_filter("properties", lambda k, v: ~fits(k, v)))
    dropped = rows.select(*_where(rows), "id", "type", F.explode(gone).alias("entry")).select(*_where(rows), "id", "type", F.col("entry.key").alias("field"), F.col("entry.value").alias("value"))
    return kept, dropped


def split_schema(rows: DataFrame, ontology: Ontology = ONTOLOGY, edges: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with the properties that their registered schema takes, and id, type, field, value and reason of all others.

    A node knows the fields of its type and of its subtype, an edge those of its semantic type
    or, if it is no related_to, of its type.  What has no schema knows no field.  A value that is
    too long or not one of a closed vocabulary is dropped too; a null value is kept.
    """
    specs = ontology.edge_properties if edges else ontology.node_properties
    if edges:
        owners = F.array(F.when(F.col("type") == "related_to", F.coalesce("semantic_type", F.lit(""))).otherwise(F.col("type")))
    else:
        owners = F.array(F.col("type"), F.concat_ws("/", "type", F.coalesce("subtype", F.lit(""))))
    fields = [(f"{o}|{f}", v) for o, fs in sorted(specs.items()) for f, v in sorted(fs.items())]
    closed = [(k, v) for k, v in fields if isinstance(v, tuple)]
    short = [(k, v) for k, v in fields if isinstance(v, int)]
    known = F.array(*[F.lit(k) for k, _ in fields])

    def reason(k: Column, v: Column) -> Column:
        keys = F.transform(owners, lambda o: F.concat_ws("|", o, k))
        bad = F.lit(False)
        for key, values in closed:
            bad = bad | (F.array_contains(keys, key) & ~v.isin(*values))
        for key, limit in short:
            bad = bad | (F.array_contains(keys, key) & (F.length(v) > limit))
        return F.when(~F.arrays_overlap(keys, known), "unknown_field").when(bad, "invalid_value")

    marked = F.map_filter(F.transform_values("properties", reason), lambda _, r: r.isNotNull())
    both = rows.withColumn("__reasons", marked)
    gone = both.select(*_where(rows), "id", "type", "properties", F.explode("__reasons").alias("field", "reason"))
    dropped = gone.select(*_where(rows), "id", "type", "field", F.element_at("properties", F.col("field")).alias("value"), "reason")
    fits = F.map_filter("properties", lambda k, _: ~F.map_contains_key(F.col("__reasons"), k))
    return both.withColumn("properties", fits).drop("__reasons"), dropped


def redirect_first_person(people: DataFrame, users: DataFrame) -> DataFrame:
    """People who go by a name of the tenant's user become ``self``, their name an alias.

    ``users`` has one row a tenant: user_id and known (names in lower case).  It is as
    small as the number of tenants, so Spark decides how to join it.
    """
    names = F.transform(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.lower(F.trim(x)))
    rows = people.join(users.select("user_id", "known"), "user_id", "left")
    me = F.coalesce((F.col("type") == "person") & F.arrays_overlap(names, F.filter("known", lambda x: F.trim(x) != "")), F.lit(False))
    aliases = F.when(me & (F.col("name") != "self"), F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))).otherwise(F.col("aliases"))
    return rows.withColumns({"aliases": aliases, "name": F.when(me, "self").otherwise(F.col("name"))}).drop("known")
