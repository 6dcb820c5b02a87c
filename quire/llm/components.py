"""Connected components of a graph that no single machine need hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """For each node of edges (a, b), the least node that it is connected with: (node, component).

    Each round takes the least label of the neighbours and then the label of the
    label, until nothing changes.  Minima are combined before they are shuffled,
    and joins have one row per key on one side, so a node with many edges is
    split by adaptive execution.  Loops, repeated edges and an empty table are fine.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        of = step.select(F.col("node").alias("_node"), F.col("component").alias("further"))
        done = cut(step.join(of, step["component"] == of["_node"]).select("node", "was", F.least("component", "further").alias("component")))
        labels = done.select("node", "component")
        if done.filter("was != component").isEmpty():
            return labels
