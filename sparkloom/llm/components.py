"""Connected components of a link table, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of `links`.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, so chains
    halve from round to round; every round is written to the shared folder and joined by node.
    """
    edges = written(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    labels = written(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("component")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        hop = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        following = written(hop.join(jump, "low", "left").select("node", F.least("low", "lower").alias("component"), (F.least("low", "lower") != F.col("component")).alias("changed")))
        labels = following.select("node", "component")
        if not following.where("changed").limit(1).count():
            return labels
