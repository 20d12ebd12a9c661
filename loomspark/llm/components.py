"""Connected components of an edge table, by minimum labels and pointer jumping; every round is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of ``edges`` (a, b); label is the smallest node of the component.

    Rounds grow with the logarithm of a component's diameter; only counts reach the driver.
    """
    spark = edges.sparkSession
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct()
    both = written(both, spark, "edges")
    labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), spark, "labels")
    while True:
        # the smallest label among a node's neighbours, then the label of that label
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        lower = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("seen", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(lower.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")), spark, "labels")
        labels = new.select("node", "label")
        if new.where("was <> label").isEmpty():
            return labels
