"""Graph expansion: directed lookups and undirected breadth-first search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .grouping import sent_or_shuffled


def graph_lookup(edges: DataFrame, seeds: DataFrame, max_depth: int, direction: str = "down") -> DataFrame:
    """Edges that a directed walk from ``seeds(id)`` meets, with the least depth (0-based) of each.

    Each step joins the new frontier with the edges once; nodes seen before are left
    out by an anti join, so a cycle ends.  Each step is written to the shared folder, so
    that later ones do not walk again.  Depth is bounded by ``max_depth``.
    ``seeds`` and ``edges`` are read at each step, so they should be tables, not long plans.
    """
    near, far = ("source_node_id", "target_node_id") if direction == "down" else ("target_node_id", "source_node_id")
    frontier = seen = seeds.select(F.col("id").alias("at")).distinct()
    n_frontier = n_seen = seeds.count()
    found = None
    for depth in range(max_depth + 1):
        step = materialise(edges.join(sent_or_shuffled(frontier, n_frontier), F.col(near) == F.col("at"), "left_semi").withColumn("depth", F.lit(depth)), "walk")
        found = step if found is None else found.unionByName(step)
        if depth < max_depth:
            frontier = materialise(step.select(F.col(far).alias("at")).distinct().join(sent_or_shuffled(seen, n_seen), "at", "left_anti"), "frontier")
            n_frontier = frontier.count()
            seen, n_seen = seen.union(frontier), n_seen + n_frontier
    return found.groupBy(*edges.columns).agg(F.min("depth").alias("depth"))


def graph_lookup_each(edges: DataFrame, seeds: DataFrame, max_depth: int, direction: str = "down") -> DataFrame:
    """As ``graph_lookup`` for each seed alone: edges with ``root``, the seed, and the least depth from it."""
    near, far = ("source_node_id", "target_node_id") if direction == "down" else ("target_node_id", "source_node_id")
    frontier = seen = materialise(seeds.where("id is not null").select(F.col("id").alias("root"), F.col("id").alias("at")).distinct(), "roots")
    found = None
    for depth in range(max_depth + 1):
        step = edges.join(frontier, F.col(near) == F.col("at")).select("root", *edges.columns, F.lit(depth).alias("depth"))
        step = materialise(step, "walk_each")
        found = step if found is None else found.unionByName(step)
        if depth < max_depth:
            frontier = materialise(step.select("root", F.col(far).alias("at")).distinct().join(seen, ["root", "at"], "left_anti"), "frontier_each")
            seen = seen.union(frontier)
    first = F.row_number().over(Window.partitionBy("root", "id").orderBy("depth"))
    # Dealt by root, which serves the ranks and whatever is grouped by root after them.
    return found.repartition("root").withColumn("__n", first).where("__n = 1").drop("__n")


def expand_graph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges within ``max_hops`` of the seeds, walking all edges down and all up, not turning."""
    seeds = materialise(seeds.select("id").distinct(), "seeds")
    walks = [graph_lookup(edges, seeds, max_hops - 1, d).drop("depth") for d in ("down", "up")]
    reached = materialise(walks[0].unionByName(walks[1]).dropDuplicates(["id"]), "reached")
    ids = reached.select(F.explode(F.array("source_node_id", "target_node_id")).alias("id")).union(seeds.select("id")).distinct()
    # Nodes that a walk reaches can be a share of all.
    return nodes.join(sent_or_shuffled(ids, 2 * reached.count() + seeds.count()), "id", "left_semi"), reached


def find_neighbors(edges: DataFrame, start: str, max_hops: int = 1, edge_types: list[str] | None = None) -> DataFrame:
    """id and hops of the nodes within ``max_hops`` of ``start`` over edges taken either way, the start left out."""
    if edge_types:
        edges = edges.where(F.col("type").isin(*edge_types))
    ends = [("source_node_id", "target_node_id"), ("target_node_id", "source_node_id")]
    steps = [edges.select(F.col(a).alias("at"), F.col(b).alias("id")) for a, b in ends]
    links = steps[0].union(steps[1])
    seen = frontier = edges.sparkSession.createDataFrame([(start, 0)], "id string, hops int")
    for hop in range(1, max_hops + 1):
        step = links.join(frontier.select(F.col("id").alias("at")), "at").select("id").distinct()
        frontier = materialise(step.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)), "hop")
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")


def missing_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name and type ``unknown`` for ends of edges that are no nodes, so that a payload has no dangling edge."""
    ends = edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("id")).distinct()
    gone = ends.join(nodes.select("id"), "id", "left_anti")
    return gone.select("id", F.element_at(F.split("id", ":", 3), -1).alias("name"), F.lit("unknown").alias("type"))


def same_as_cluster(edges: DataFrame, seed: str) -> DataFrame:
    """The seed and all nodes one same_as edge away, whatever its state."""
    same = edges.where(F.col("type") == "same_as")
    near = same.where((F.col("source_node_id") == seed) | (F.col("target_node_id") == seed))
    found = near.select(F.explode(F.array("source_node_id", "target_node_id")).alias("id")).distinct()
    return found.union(edges.sparkSession.createDataFrame([(seed,)], "id string")).distinct()
