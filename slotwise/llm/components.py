"""Connected components of an edge table by lowest neighbour label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import stored

#: Edges for which there is a task.
A_TASK = 20_000


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every end of the edges (a, b); the label is the lowest node of the component.

    Each round gives a node the lowest label among its own and its neighbours', then the label of
    that label, so that labels travel along doubling distances. Rounds end when no label changes. An
    empty edge table gives an empty result. Tables are written by one task for every ``A_TASK`` edges at
    most: rounds over few edges are otherwise spent on starting tasks. ``edges`` should be a stored table.
    """
    tasks = edges.count() // A_TASK + 1
    few = lambda df, name: stored(df.coalesce(tasks), name)
    both = few(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    labels = few(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        lower = few(labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "labels")
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        after = few(lower.join(up, "label").select("node", "old", F.least("label", "upper").alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where("old <> label").isEmpty():
            return labels
