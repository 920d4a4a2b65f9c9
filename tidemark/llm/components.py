"""Connected components of a graph of written edges: smallest labels spread along edges and jump along themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node that can be reached.

    A round is three equi-joins and a pre-aggregated minimum, so that a node with very many edges and a component with
    very many nodes are split like any skewed join; its result is written. Rounds grow with the logarithm of a
    component's diameter.
    """
    both = edges.select(F.col("a").alias("s"), F.col("b").alias("t")).union(edges.select(F.col("b").alias("s"), F.col("a").alias("t"))).where("s <> t")
    labels = written(both.groupBy("s").agg(F.least(F.col("s"), F.min("t")).alias("label")).withColumnRenamed("s", "node"), "labels")
    while True:
        near = both.join(labels, F.col("t") == F.col("node")).groupBy("s").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("s")).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = written(step.join(jump, F.col("next") == F.col("via"), "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), F.col("label").alias("old")), "labels")
        labels = new.select("node", "label")
        if not new.where("label <> old").limit(1).count():
            return labels
