"""Connected components by the smallest label, as joins over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtables.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of ``edges`` (a, b): node, component.

    Every round takes the smallest label of a node and its neighbours and then jumps to
    the label's own label; each is written, so a lost executor costs one round. Loops,
    repeated edges and either direction are allowed; no edges give no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.where("a IS NOT NULL AND b IS NOT NULL").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = cut_lineage(
            lower.join(jump, "component", "left").select(
                "node", "old", F.least("component", F.coalesce("next", "component")).alias("component")
            )
        )
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels
