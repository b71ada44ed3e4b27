"""Connected components of links between nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def component_roots(pairs: DataFrame) -> DataFrame:
    """id and root, the smallest id of its component, for each id of ``pairs(a_id, b_id)``.

    Each round a node takes the least root that any neighbour has, and then the root of that
    root, so the length of paths halves.  What a hub's neighbours say is brought down to one
    row a task before the shuffle.
    """
    links = pairs.select(F.col("a_id").alias("id"), F.col("b_id").alias("other"))
    links = materialise(links.unionByName(links.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct(), "links")
    roots = materialise(links.groupBy("id").agg(F.least("id", F.min("other")).alias("root")), "roots")
    while True:
        told = links.join(roots.select(F.col("id").alias("other"), "root"), "other").groupBy("id").agg(F.min("root").alias("told"))
        near = roots.join(told, "id").select("id", F.col("root").alias("old"), F.least("root", "told").alias("root"))
        up = roots.select(F.col("id").alias("root"), F.col("root").alias("up"))
        new = materialise(near.join(up, "root", "left").select("id", "old", F.least("root", "up").alias("root")), "roots")
        roots = new.select("id", "root")
        if new.where("old <> root").isEmpty():
            return roots
