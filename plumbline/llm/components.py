"""Connected components of an edge table by propagating smallest labels and jumping to the labels' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of an edge (columns a, b); label is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then that node's own label; the number of
    rounds grows with the logarithm of the longest chain. Rounds are written to the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "cc-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("now"))
        to = labels.select(F.col("node").alias("of"), F.col("label").alias("onward"))
        step = written(step.join(to, step["now"] == to["of"], "left").select("node", "was", F.least("now", F.coalesce("onward", "now")).alias("label")), "cc-labels")
        labels = step.select("node", "label")
        if step.where("label <> was").isEmpty():
            return labels
