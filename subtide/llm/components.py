"""Connected components by smallest labels, with shortcuts, over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the edges (a, b); label: the smallest node of the component.

    Each round takes the smallest label among a node's neighbours and then the label of its label, so rounds grow
    with the logarithm of a component's width. Both sides of every join are tables on disk, so that an adaptive
    plan can split a node with very many neighbours; sums over neighbours are pre-aggregated.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("before"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = near.join(far, "label").select("node", F.least("label", "far").alias("label"), "before")
        new = written(new)
        changed = new.filter(F.col("label") < F.col("before")).limit(1).count()
        dropped(labels)
        labels = new.drop("before")
        labels._subtide_path = new._subtide_path
        if not changed:
            dropped(both)
            return labels
