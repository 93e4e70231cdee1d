"""Connected components of a bounded-degree graph by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.common import forget, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node that can be reached.

    A round takes the smallest label among neighbours, then jumps to the label's own label, so the distance
    covered doubles; every round is a written table. Ends when no label changes.
    """
    both = settle(edges.select(F.col("a").alias("node"), F.col("b").alias("to"))
                  .union(edges.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct())
    labels = settle(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("to"), "label"), "to")
        near = (seen.select("node", "label").union(labels).groupBy("node").agg(F.min("label").alias("near")))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        moved = (near.join(jump, "near").join(labels.withColumnRenamed("label", "old"), "node")
                 .select("node", F.least("near", "far").alias("label"), "old"))
        moved = settle(moved)
        done = moved.where("label != old").limit(1).count() == 0
        forget(labels)
        labels = moved.select("node", "label")
        if done:
            forget(both)
            return labels
