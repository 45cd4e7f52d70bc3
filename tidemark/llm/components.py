"""Connected components by joins: every node takes the least label around it, then its label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is the least node reachable.

    Rounds end when no label changes; with labels of labels followed in each, their
    number grows with the logarithm of the longest path.  A hub's edges meet its label in a
    join, which Spark can split, and minima are partly aggregated before they move.
    """
    both = written(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "cc-labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("seen"))
        lower = written(labels.join(around, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "seen").alias("component")), "cc-lower")
        up = lower.select(F.col("node").alias("up_node"), F.col("component").alias("up_component"))
        jumped = lower.join(up, F.col("component") == F.col("up_node"), "left").select("node", "was", F.least("component", F.coalesce("up_component", "component")).alias("component"))
        jumped = written(jumped, "cc-labels")
        if jumped.where("component <> was").isEmpty():
            return jumped.select("node", "component")
        labels = jumped.select("node", "component")
