"""Connected components of a link table, by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of ``links`` (a, b): the smallest node of its component.

    Each round takes the smallest label among neighbours and then the label of that label, so
    a path's length shrinks by a power each time. Every round is written to the shared folder;
    rounds end when none of the labels changes. Joined sides are plain scans, so that a node
    with very many links is split among tasks at run time.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        told = both.join(labels.withColumnRenamed("node", "_n"), F.col("a") == F.col("_n")).select(F.col("b").alias("node"), "label")
        near = materialize(told.union(labels).groupBy("node").agg(F.min("label").alias("label")), "near")
        hop = near.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = materialize(near.join(hop, F.col("label") == F.col("_n")).select("node", F.least("label", "_l").alias("label")), "labels")
        moved = not new.join(labels.withColumnRenamed("label", "_was"), "node").filter("label <> _was").isEmpty()
        discard(near, labels)
        labels = new
        if not moved:
            discard(both)
            return labels
