"""Near-duplicate decisions, merges, review and incremental consolidation of nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import indel_similarity
from ..functions.text import capped_union, edge_id, merge_maps, normalize_name, per_key_merge
from ..storage import materialise
from .components import component_roots
from .grouping import first_values
from .neighbors import nearest_in_tiles

MAX_ALIASES, MAX_SOURCES = 50, 500


@dataclass(frozen=True)
class DedupConfig:
    """Thresholds in [0, 1], with merging strictly above flagging."""

    merge: float = 0.95
    flag: float = 0.85
    fuzzy: float = 0.90
    use_fuzzy: bool = True
    candidates: int = 10
    filter_first: bool = False

    def __post_init__(self):
        if not (0 <= self.flag < self.merge <= 1 and 0 <= self.fuzzy <= 1 and self.candidates > 0):
            raise ValueError("thresholds lie in [0, 1], merge above flag, and candidates are positive")


def surfaces(prefix: str = "") -> Column:
    """The distinct names by which a node is known, normalised."""
    names = F.concat(F.array(F.col(prefix + "name"), F.col(prefix + "canonical_name")), F.coalesce(F.col(prefix + "aliases"), F.array().cast("array<string>")))
    return F.array_distinct(F.transform(F.filter(names, lambda x: x.isNotNull() & (x != "")), normalize_name))


def rejected_pairs(same_as: DataFrame) -> DataFrame:
    """low_id and high_id of pairs that a reviewer has rejected, whichever way the edge points."""
    rejected = same_as.where(F.element_at("properties", "status") == "rejected")
    return ordered_pairs(rejected, "source_node_id", "target_node_id").select("low_id", "high_id").distinct()


def ordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumns({"low_id": F.least(a, b), "high_id": F.greatest(a, b)})


def decide(drivers: DataFrame, nodes: DataFrame, same_as: DataFrame | None = None, config: DedupConfig = DedupConfig()) -> DataFrame:
    """left_id, matched_id, score, match_type and action (merged, flagged or none) for each driver.

    Both tables have id, user_id, type, name, canonical_name, aliases, merged_into and
    embedding.  The nearest ``candidates`` of the same tenant and type are taken first;
    then the driver itself, tombstones and rejected pairs go (before, with
    ``filter_first``).  A candidate whose name is alike scores the mean of both scores,
    and its vector alone no longer counts.  Ties go to the nearer candidate.
    """
    alive = nodes.where(F.coalesce("merged_into", F.lit("")) == "")
    pool = alive if config.filter_first else nodes
    near = nearest_in_tiles(drivers, pool, ["user_id", "type"], config.candidates + config.filter_first)
    near = near.where(F.col("left_id") != F.col("right_id"))
    near = near.join(alive.select(F.col("id").alias("right_id"), surfaces().alias("surfaces")), "right_id")
    near = near.join(drivers.select(F.col("id").alias("left_id"), normalize_name(F.col("name")).alias("left_name")), "left_id")
    if same_as is not None:
        near = ordered_pairs(near, "left_id", "right_id").join(rejected_pairs(same_as), ["low_id", "high_id"], "left_anti").drop("low_id", "high_id")
    semantic = F.col("score")
    if config.use_fuzzy:
        each = near.select("left_id", "right_id", "left_name", F.explode("surfaces").alias("surface"))
        fuzzy = each.withColumn("ratio", F.round(indel_similarity("left_name", "surface"), 9)).groupBy("left_id", "right_id").agg(F.max("ratio").alias("ratio"))
        near = near.join(fuzzy, ["left_id", "right_id"], "left")
        both = F.coalesce(F.col("ratio") >= config.fuzzy, F.lit(False))
        final, kind = F.when(both, (semantic + F.col("ratio")) / 2).otherwise(semantic), F.when(both, "both").otherwise("embedding")
    else:
        final, kind = semantic, F.lit("embedding")
    best = near.withColumns({"final": final, "match_type": kind}).where(F.col("final") > 0)
    best = best.groupBy("left_id").agg(F.max_by(F.struct("right_id", "match_type", "final"), F.struct("final", (-F.col("rank")).alias("near"))).alias("best"))
    action = F.when(F.col("best.final") >= config.merge, "merged").when(F.col("best.final") >= config.flag, "flagged").otherwise("none")
    out = drivers.select(F.col("id").alias("left_id")).join(best, "left_id", "left").withColumn("action", F.coalesce(action, F.lit("none")))
    hit = F.col("action") != "none"
    return out.select("left_id", F.when(hit, F.col("best.right_id")).alias("matched_id"), F.round(F.when(hit, F.col("best.final")), 9).alias("score"), F.when(hit, F.col("best.match_type")).alias("match_type"), "action")


def sweep(nodes: DataFrame, same_as: DataFrame, watermark: Column, config: DedupConfig = DedupConfig(), max_pairs: int | None = 1000) -> DataFrame:
    """Pairs to merge or flag: changed nodes drive, all nodes are searched.

    A pair with a same_as edge either way, of whatever state, is done already.  With
    ``max_pairs`` the first in order of their ids are taken; None takes all, unordered.
    """
    searchable = nodes.where((F.coalesce("merged_into", F.lit("")) == "") & (F.coalesce(F.size("embedding"), F.lit(0)) > 0) & ~F.col("type").isin("document", "chunk"))
    decisions = decide(searchable.where(F.col("updated_at") > watermark), searchable, None, config).where("action <> 'none'")
    pairs = ordered_pairs(decisions, "left_id", "matched_id")
    pairs = pairs.groupBy("low_id", "high_id").agg(F.max_by(F.struct("score", "match_type", "action"), "score").alias("x")).select("low_id", "high_id", "x.*")
    done = ordered_pairs(same_as, "source_node_id", "target_node_id").select("low_id", "high_id").distinct()
    pairs = pairs.join(done, ["low_id", "high_id"], "left_anti")
    return pairs if max_pairs is None else pairs.orderBy("low_id", "high_id").limit(max_pairs)


def winner_first() -> Column:
    """Whether node a of a pair wins over b: the older, then the surer, then the smaller id."""
    a, b = F.col("a_created_at"), F.col("b_created_at")
    ca, cb = F.coalesce("a_confidence", F.lit(0.0)), F.coalesce("b_confidence", F.lit(0.0))
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), a < b).when(ca != cb, ca > cb).otherwise(F.col("a_id") < F.col("b_id"))


def merge_nodes(pairs: DataFrame, strategy: str = "merge_properties") -> DataFrame:
    """The winner's row after a merge: ``pairs`` has columns w_* and l_* of winner and loser.

    keep_primary takes the loser's names, sources and the higher confidence;
    merge_properties its properties too; keep_aliases only names and sources.
    """
    if strategy not in ("keep_primary", "merge_properties", "keep_aliases"):
        raise ValueError(strategy)
    names = F.array_union(F.coalesce("l_aliases", F.array().cast("array<string>")), F.array("l_name"))
    out = {"id": F.col("w_id"), "aliases": capped_union(F.col("w_aliases"), names, MAX_ALIASES), "sources": capped_union(F.col("w_sources"), F.col("l_sources"), MAX_SOURCES)}
    out["confidence"] = F.col("w_confidence") if strategy == "keep_aliases" else F.greatest("w_confidence", "l_confidence")
    out["properties"] = per_key_merge(F.col("w_properties"), F.col("l_properties")) if strategy == "merge_properties" else F.col("w_properties")
    return pairs.select(*[c.alias(k) for k, c in out.items()])


def transfer_edges(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges after losers became winners: re-keyed, without self-loops, one row an id.

    ``merged`` has loser_id and winner_id.  Where two edges fall together the one that was
    there keeps its properties, and the other's fill what is missing; the semantic type
    goes along.
    """
    out = edges.withColumn("moved", F.lit(False))
    for end in ("source_node_id", "target_node_id"):
        to = merged.select(F.col("loser_id").alias(end), F.col("winner_id").alias("__to"))
        out = out.join(to, end, "left").withColumns({"moved": F.col("moved") | F.col("__to").isNotNull(), end: F.coalesce("__to", end)}).drop("__to")
    out = out.where(F.col("source_node_id") != F.col("target_node_id"))
    out = out.withColumn("new_id", F.when(F.col("moved"), edge_id(F.col("source_node_id"), F.col("type"), F.col("target_node_id"))).otherwise(F.col("id")))
    order = F.struct("moved", "id")
    firsts = [F.min_by(c, order).alias(c) for c in ("user_id", "type", "semantic_type", "source_node_id", "source_type", "target_node_id", "target_type")]
    # The edge that was there comes last, so its properties stay.
    merged_maps = merge_maps(F.collect_list(F.struct((~F.col("moved")).alias("stays"), "id", "properties")), ["stays", "id"])
    return out.groupBy(F.col("new_id")).agg(*firsts, merged_maps.alias("properties")).withColumnRenamed("new_id", "id")


def pending_reviews(same_as: DataFrame, nodes: DataFrame, limit: int, node_type: str | None = None) -> DataFrame:
    """Pending pairs with both nodes' names, surest first; the limit is taken before the joins, as reviews page."""
    confidence = F.element_at("properties", "confidence").cast("double")
    top = same_as.where(F.element_at("properties", "status") == "pending").select("id", "source_node_id", "target_node_id", confidence.alias("confidence")).orderBy(F.desc("confidence"), "id").limit(limit)
    for side in ("source", "target"):
        names = nodes.select(F.col("id").alias(f"{side}_node_id"), F.col("name").alias(f"{side}_name"), F.col("type").alias(f"{side}_type"))
        top = top.join(names, f"{side}_node_id")
    return top if node_type is None else top.where(F.col("source_type") == node_type)


def set_review(same_as: DataFrame, edge: str, status: str) -> DataFrame:
    """The edges with one review decided.  A decision is final: the other one raises, the same one changes nothing."""
    if status not in ("confirmed", "rejected"):
        raise ValueError(status)
    now = F.element_at("properties", "status")
    bad = (F.col("id") == edge) & ~now.isin("pending", status)
    new = F.when(bad, F.raise_error(F.lit("the review is decided otherwise"))).otherwise(F.when(F.col("id") == edge, F.map_concat("properties", F.create_map(F.lit("status"), F.lit(status)))).otherwise(F.col("properties")))
    return same_as.withColumn("properties", new)


def upsert_pending(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """same_as rows (id, score, status, created_at) after new scores: status and creation stay as they were."""
    new = incoming.select("id", F.col("score").alias("n_score"), F.col("created_at").alias("n_created_at"))
    rows = current.join(new, "id", "full_outer")
    return rows.select("id", F.coalesce("n_score", "score").alias("score"), F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("created_at", "n_created_at").alias("created_at"))


def edge_collapse(edges: DataFrame, order: str) -> DataFrame:
    """One row an edge id: the last in ``order``."""
    last = Window.partitionBy("id").orderBy(F.desc(order))
    return edges.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def live_ends(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a_id, b_id) of different live nodes: a tombstone's end goes to the node that it was merged into."""
    gone = nodes.where(F.coalesce("merged_into", F.lit("")) != "").select("id", F.col("merged_into").alias("into"))
    pairs = materialise(pairs.select("a_id", "b_id"), "pairs")
    # A merge may have followed a merge; each round takes one step of all ends.
    while True:
        for end in ("a_id", "b_id"):
            pairs = pairs.join(gone.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
        pairs = materialise(pairs.where("a_id <> b_id").distinct(), "pairs")
        ends = pairs.select(F.col("a_id").alias("id")).unionByName(pairs.select(F.col("b_id").alias("id")))
        if ends.join(gone, "id", "left_semi").isEmpty():
            break
    for end in ("a_id", "b_id"):
        pairs = pairs.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return pairs


def contractions(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """winner_id and loser_id for each node but one of each component of ``pairs``, and the loser's place behind the winner.

    The winner is the oldest, if all of the component have a date, then the surest, then the
    one with the smallest id: for a single pair this is ``winner_first``.  The order of
    the pairs does not matter.
    """
    of = component_roots(pairs).join(nodes.select("id", "created_at", F.coalesce("confidence", F.lit(0.0)).alias("sure")), "id")
    dated = of.groupBy("root").agg(F.count_if(F.col("created_at").isNull()).alias("undated"))
    placed = of.join(dated, "root").select("root", "id", F.struct(F.when(F.col("undated") == 0, F.col("created_at")).alias("created_at"), (-F.col("sure")).alias("sure"), "id").alias("place"))
    first = placed.groupBy("root").agg(F.min_by("id", "place").alias("winner_id"))
    return placed.join(first, "root").where("id <> winner_id").select("winner_id", F.col("id").alias("loser_id"), "place")


def confirm(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, now: Column, strategy: str = "merge_properties") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the merges of confirmed ``pairs`` (a_id, b_id), which may share nodes.

    Nodes that pairs connect become one: the winner takes what the strategy says of all
    others, which become tombstones that name it; edges go to the winner.  Ends that are
    tombstones already stand for the node that they were merged into, so a repeated run
    gives the same tables.
    """
    if strategy not in ("keep_primary", "merge_properties", "keep_aliases"):
        raise ValueError(strategy)
    merged = materialise(contractions(nodes, live_ends(nodes, pairs)), "contractions")
    losers = merged.join(nodes.select(F.col("id").alias("loser_id"), "name", "aliases", "sources", "confidence", "properties"), "loser_id")
    names = F.explode(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name")))
    kept = first_values(losers.select("winner_id", names.alias("value")), "winner_id", F.col("value"), MAX_ALIASES, "n_aliases")
    sources = losers.select("winner_id", F.explode("sources").alias("value"))
    kept = kept.join(first_values(sources, "winner_id", F.col("value"), MAX_SOURCES, "n_sources"), "winner_id", "left")
    kept = kept.join(losers.groupBy("winner_id").agg(F.max("confidence").alias("n_confidence")), "winner_id", "left")
    each = losers.select("winner_id", "place", F.explode("properties").alias("field", "value")).where("value is not null")
    # Of equal lengths the value of the loser next to the winner stays.
    each = each.groupBy("winner_id", "field").agg(F.min_by("value", F.struct((-F.length("value")).alias("n"), "place")).alias("value"))
    maps = each.groupBy("winner_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("n_properties"))
    kept = kept.join(maps, "winner_id", "left").withColumnRenamed("winner_id", "id")

    out = nodes.join(kept, "id", "left").join(merged.select(F.col("loser_id").alias("id"), "winner_id"), "id", "left")
    won, none = F.col("n_aliases").isNotNull(), F.create_map().cast("map<string,string>")
    new = {"aliases": capped_union(F.col("aliases"), F.col("n_aliases"), MAX_ALIASES), "sources": capped_union(F.col("sources"), F.col("n_sources"), MAX_SOURCES)}
    if strategy != "keep_aliases":
        new["confidence"] = F.greatest("confidence", "n_confidence")
    if strategy == "merge_properties":
        new["properties"] = per_key_merge(F.coalesce("properties", none), F.coalesce("n_properties", none))
    new = {c: F.when(won, v).otherwise(F.col(c)) for c, v in new.items()}
    new |= {"merged_into": F.coalesce("winner_id", "merged_into"), "merged_at": F.when(F.col("winner_id").isNotNull(), now).otherwise(F.col("merged_at"))}
    return out.withColumns(new).select(*nodes.columns), transfer_edges(edges, merged.select("loser_id", "winner_id"))


def sweep_writes(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a sweep writes: pairs to confirm, and pending same_as rows for those that are flagged."""
    flagged = pairs.where("action = 'flagged'").select(F.concat_ws("|", "low_id", F.lit("same_as"), "high_id").alias("id"), F.col("low_id").alias("source_node_id"), F.col("high_id").alias("target_node_id"), "score", F.lit("pending").alias("status"))
    return pairs.where("action = 'merged'").select(F.col("low_id").alias("a_id"), F.col("high_id").alias("b_id")), flagged


def apply_sweep(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, now: Column, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a sweep's pairs: those to merge are confirmed, flagged ones wait for a review.

    A review that is there keeps its state.  A dry run writes nothing: both tables are as they were.
    """
    if dry_run:
        return nodes, edges
    confirmed, flagged = sweep_writes(pairs)
    out, moved = confirm(nodes, edges, confirmed, now)
    ends = nodes.select(F.col("id").alias("source_node_id"), "type", *[c for c in ("user_id",) if c in nodes.columns])
    state = F.create_map(F.lit("status"), F.col("status"), F.lit("confidence"), F.col("score").cast("string"))
    new = flagged.join(ends, "source_node_id").withColumns({"source_type": F.col("type"), "target_type": F.col("type"), "properties": state, "type": F.lit("same_as")})
    # An end may have been merged by the same sweep.
    gone = out.where(F.col("merged_into").isNotNull()).select("id")
    for end in ("source_node_id", "target_node_id"):
        new = new.join(gone.withColumnRenamed("id", end), end, "left_anti")
    new = new.join(moved.select("id"), "id", "left_anti")
    return out, moved.unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(moved.schema[c].dataType).alias(c) for c in moved.columns]))


@dataclass(frozen=True)
class ExtractionConfig:
    """What resolution and comparison must agree on: whether only nodes of one type are matched."""

    type_strict: bool = True
    same_type_only: bool = True

    def __post_init__(self):
        if self.type_strict != self.same_type_only:
            raise ValueError("resolution and comparison must both match within a type, or both across types")
