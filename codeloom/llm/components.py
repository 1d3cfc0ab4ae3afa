"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node that has an edge (a, b), with the least node of its component."""
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "node"))
    while True:
        around = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        near = labels.join(around, labels["node"] == around["u"]).select("node", F.least("label", "near").alias("near"))
        far = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        new = written(near.join(far, "near").select("node", F.least("near", "far").alias("label")))
        changed = not new.join(labels, ["node", "label"], "left_anti").isEmpty()
        dropped(labels)
        labels = new
        if not changed:
            dropped(both)
            return labels
