"""Connected components of an edge table, without gathering edges or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumframe.llm.work import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (a, b); root is the smallest node that can be reached.

    Each round takes the smallest label among neighbours, then the label of that label (pointer jumping), so the number
    of rounds grows with the logarithm of a component's width. Rounds end with a written table. Nulls are no nodes.
    """
    both = cut(edges.where("a is not null and b is not null").select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        done = cut(step.join(up, "root").select("node", F.least("root", "top").alias("root"), "was"), "labels")
        labels = done.select("node", "root")
        if done.where("root <> was").isEmpty():
            return labels
