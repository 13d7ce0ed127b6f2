"""Connected components of an edge table by shrinking labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (of any type with an order) -> node, label: the smallest node reachable; only nodes with an edge.

    Each round gives a node the smallest label around it and then the label of its label, so
    paths halve. A node with very many edges is one row of a partial aggregation per task.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = written(lower.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        if after.where("old <> label").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
