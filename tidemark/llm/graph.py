"""Connected components of a graph too large for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of undirected edges (a, b): label is the smallest node of the component.

    Each round every node takes the smallest label next to it and then that label's own label, so paths shrink by half and
    more; stars end in two rounds. Every round is written to the shared folder. Nothing but a count reaches the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ends = labels.select(F.col("node").alias("end"), F.col("label").alias("beyond"))
        moved = materialise(moved.join(ends, moved["label"] == ends["end"]).select("node", "old", F.least("label", "beyond").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("old <> label").isEmpty():
            return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) after more edges (a, b), of which there may be few: only the components they touch are joined."""
    ends = labels.toDF("end", "of")
    at = edges.join(ends, edges["a"] == ends["end"], "left").select(F.coalesce("of", "a").alias("a"), "b")
    between = at.join(ends, at["b"] == ends["end"], "left").select("a", F.coalesce("of", "b").alias("b")).filter("a <> b").distinct()
    moves = components(between)
    new = moves.select("node").join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    to = moves.toDF("from", "to")
    every = labels.unionByName(new)
    return materialise(every.join(to, every["label"] == to["from"], "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
