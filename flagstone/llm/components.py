"""Connected components of a distributed graph whose nodes are pairs of longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone.llm.common import written


def label_components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (the least node of its component) from ``a``, ``b``, all structs of two longs.

    Every round a node and its label take the least label seen over an edge, then labels are replaced
    by the labels of labels; rounds grow with the logarithm of the longest path. Each round is written
    to the shared folder, so a lost executor costs one round at most.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.filter("a != b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        seen = both.join(of_a, "a").join(of_b, "b").filter("lb < la")
        offers = seen.select(F.col("a").alias("node"), F.col("lb").alias("label")).union(
            seen.select(F.col("la").alias("node"), F.col("lb").alias("label"))
        )
        lower = labels.union(offers).groupBy("node").agg(F.min("label").alias("label"))
        onward = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = written(lower.join(onward, "label").select("node", F.col("next").alias("label")), "labels")
        changed = after.join(labels.withColumnRenamed("label", "old"), "node").filter("label != old")
        done = changed.isEmpty()
        labels = after
        if done:
            return labels
