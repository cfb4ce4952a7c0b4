"""Connected components of an edge table by label propagation with pointer jumping, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node of the edges (a, b): the smallest node it reaches.

    Each round takes the least label of the neighbours and then the label's own label, until nothing
    changes; chains halve in every round.  Hubs are reduced inside the tasks before the shuffle, and
    the joins are plain equi-joins, which adaptive execution splits.
    """
    # edges go to the smaller label of their ends, so each round's edge table is the contracted one
    links = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = materialize(nodes.withColumn("label", F.col("node")), name)
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("old"), F.least("a", "least").alias("new"))
        step = materialize(least, name)
        jump = step.alias("s").join(step.alias("t"), F.col("s.new") == F.col("t.old"), "left").select(
            F.col("s.old").alias("old"), F.coalesce("t.new", "s.new").alias("new"))
        jump = materialize(jump, name)
        labels = materialize(labels.join(jump, labels["label"] == jump["old"], "left").select("node", F.coalesce("new", "label").alias("label")), name)
        moved = links.join(jump.toDF("a", "na"), "a").join(jump.toDF("b", "nb"), "b").where("na != nb")
        links = materialize(moved.select(F.greatest("na", "nb").alias("a"), F.least("na", "nb").alias("b")).distinct(), name)
    return labels
