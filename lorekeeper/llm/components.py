"""Connected components of large sets of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for all nodes of ``links(a, b)``.

    Each round every node takes the smallest label among its neighbours and then the
    label of its label, so paths halve; a star needs one round.  Labels are written to
    the shared folder after each round.  Neighbours' labels are minimised before the
    shuffle, so a node with very many links takes one row from each task.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = materialise(both.union(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = materialise(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other")
        near = near.groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = materialise(lower, "lower")
        if lower.where("label <> old").limit(1).count() == 0:
            return labels
        of = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = materialise(lower.join(of, "label").select("node", F.least("label", "up").alias("label")), "labels")
