"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscale.runtime import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "id", start: str = "a", end: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node.

    Each round every node takes the smallest label among its own, its
    neighbours' and its label's; labels halve their distance to the root, so
    rounds grow with the logarithm of the longest path. Labels are written to
    the checkpoint folder each round. Nodes without edges are components of
    their own; edges of unknown nodes are ignored.
    """
    both = edges.select(F.col(start).alias("x"), F.col(end).alias("y")).unionByName(edges.select(F.col(end).alias("x"), F.col(start).alias("y"))).where("x <> y").distinct()
    both = cut_lineage(both)
    linked = nodes.select(F.col(node).alias("x")).join(both.select("x").distinct(), "x", "left_semi")
    labels = cut_lineage(linked.select("x", F.col("x").alias("label")))
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        lower = labels.join(near, "x", "left").select("x", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = lower.select(F.col("x").alias("new"), F.col("new").alias("far"))
        step = lower.join(jump, "new", "left").select("x", "label", F.coalesce("far", "new").alias("new"))
        step = cut_lineage(step)
        if not step.where("new <> label").take(1):
            break
        labels = step.select("x", F.col("new").alias("label"))
    rest = nodes.select(F.col(node).alias("x")).join(labels, "x", "left_anti").select("x", F.col("x").alias("label"))
    return labels.unionByName(rest).select(F.col("x").alias(node), F.col("label").alias("component"))
