"""Entity resolution: alias, then exact, then fuzzy, then semantic matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import token_sort
from ..functions.text import normalize_name
from ..storage import materialise
from .fuzzy import similar_names
from .grouping import shuffled
from .neighbors import nearest_in_tiles

FUZZY, SEMANTIC = 0.85, 0.80
STAGES = ("alias", "exact", "fuzzy", "semantic")


def live_candidates(nodes: DataFrame, cap: int | None = None) -> DataFrame:
    """All nodes but tombstones, or with ``cap`` the first of each tenant and type by their ids."""
    alive = nodes.where(F.coalesce("merged_into", F.lit("")) == "") if "merged_into" in nodes.columns else nodes
    if cap is None:
        return alive
    order = Window.partitionBy("user_id", "type").orderBy("id")
    return alive.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).drop("place")


def alias_matches(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Mentions whose name is an alias of a candidate of their tenant and type."""
    known = candidates.select("user_id", "type", F.col("id").alias("matched_id"), F.explode("aliases").alias("alias"))
    known = known.withColumn("key", normalize_name(F.col("alias")))
    return mentions.withColumn("key", normalize_name(F.col("name"))).join(shuffled(known), ["user_id", "type", "key"]).select("mention_id", "matched_id", F.lit(0).alias("stage"), F.lit(1.0).alias("score"))


def exact_matches(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    known = candidates.select("user_id", "type", F.col("id").alias("matched_id"), normalize_name(F.col("name")).alias("key"))
    return mentions.withColumn("key", normalize_name(F.col("name"))).join(shuffled(known), ["user_id", "type", "key"]).select("mention_id", "matched_id", F.lit(1).alias("stage"), F.lit(1.0).alias("score"))


def fuzzy_matches(mentions: DataFrame, candidates: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """Mentions whose sorted words are like a candidate's.

    Names are compared with their words in order, equal ones once, and only those that
    share a signature (``fuzzy``), which no pair that reaches the threshold misses.
    """
    sorted_name = token_sort(normalize_name(F.col("name")))
    left, right = (df.select("user_id", "type", sorted_name.alias("name")) for df in (mentions, candidates))
    scored = similar_names(left, right, ["user_id", "type"], threshold)
    by_name = candidates.select("user_id", "type", F.col("id").alias("matched_id"), sorted_name.alias("right_name"))
    found = mentions.withColumn("left_name", sorted_name).join(shuffled(scored), ["user_id", "type", "left_name"]).join(shuffled(by_name), ["user_id", "type", "right_name"])
    return found.select("mention_id", "matched_id", F.lit(2).alias("stage"), "score")


def semantic_matches(mentions: DataFrame, candidates: DataFrame, threshold: float = SEMANTIC) -> DataFrame:
    """Mentions whose embedding is near a candidate's; both sides need an ``embedding``."""
    side = lambda df, i: df.where(F.size("embedding") > 0).select("user_id", "type", F.col(i).alias("id"), "embedding")
    found = nearest_in_tiles(side(mentions, "mention_id"), side(candidates, "id"), ["user_id", "type"], least=threshold, clamp=True)
    return found.select(F.col("left_id").alias("mention_id"), F.col("right_id").alias("matched_id"), F.lit(3).alias("stage"), "score")


def resolve(mentions: DataFrame, candidates: DataFrame, semantic: bool = False, fuzzy: float = FUZZY, near: float = SEMANTIC) -> DataFrame:
    """mention_id, matched_id, match_type and confidence for every mention; without a match the last three say so.

    The first stage that matches decides; in it the best score, then the
    candidate with the smallest id.
    """
    # Written: the result reads these matches, and so does each later stage, which takes only what equality leaves over.
    found = [materialise(alias_matches(mentions, candidates).unionByName(exact_matches(mentions, candidates)), "equal")]
    rest = mentions.join(shuffled(found[0].select("mention_id")), "mention_id", "left_anti")
    found += [fuzzy_matches(rest, candidates, fuzzy)] + ([semantic_matches(rest, candidates, near)] if semantic else [])
    best = reduce(DataFrame.unionByName, found).groupBy("mention_id").agg(F.min(F.struct("stage", (-F.col("score")).alias("score"), "matched_id")).alias("best"))
    names = F.array(*[F.lit(s) for s in STAGES])
    out = mentions.select("mention_id").join(shuffled(best), "mention_id", "left")
    return out.select("mention_id", F.col("best.matched_id").alias("matched_id"), F.coalesce(F.get(names, F.col("best.stage")), F.lit("none")).alias("match_type"), F.coalesce(-F.col("best.score"), F.lit(0.0)).alias("confidence"))


def remap_endpoints(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges with ends replaced by what they were resolved to, self-loops left out."""
    for end in ("source_node_id", "target_node_id"):
        to = resolved.select(F.col("built_id").alias(end), F.col("node_id").alias("__to"))
        edges = edges.join(shuffled(to), end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
    return edges.where(F.col("source_node_id") != F.col("target_node_id"))
