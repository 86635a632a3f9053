"""Connected components of edges between whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed

#: Edges up to this number (16 bytes each) are solved on the driver: a round of joins costs more there than the edges themselves.
SMALL = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b long): the smallest node reachable.

    The edges are read twice. Where there are more than SMALL, each round lowers the label of a node, and of the label's own node, to the smallest label among
    its neighbours, then follows labels of labels; the number of rounds grows with the logarithm of
    the longest path. Only a count of changes reaches the driver then.
    """
    if edges.count() <= SMALL:
        table = edges.select("a", "b").toArrow()
        node, component = solved(table["a"].to_numpy(), table["b"].to_numpy())
        return checkpointed(edges.sparkSession.createDataFrame(pa.table({"node": node, "component": component}), "node long, component long"))
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("l_b"))
        of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("l_a"))
        least = both.join(of_b, "b").groupBy("a").agg(F.min("l_b").alias("l")).join(of_a, "a")
        offers = least.select(F.col("a").alias("node"), "l").union(least.where("l < l_a").select(F.col("l_a").alias("node"), "l")).groupBy("node").agg(F.min("l").alias("l"))
        lower = labels.join(offers, "node").select("node", F.least("component", "l").alias("component"), F.col("component").alias("was"))
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = checkpointed(lower.join(up, "component").select("node", F.least("component", "up").alias("component"), "was"))
        labels = new.select("node", "component")
        if new.where("component != was").isEmpty():
            return labels


def solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges in ascending order, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]).astype(np.int64), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        least = np.minimum(label[x], label[y])
        for side in (label[x], label[y]):  # the label's own node goes down, and all that point to it follow
            np.minimum.at(label, side, least)
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def joined(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The labels (node, component) after edges (a, b) between them: only components and new nodes that the edges touch are worked on."""
    if labels is None:
        return components(edges)
    of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    top = components(checkpointed(ends.where("a != b").distinct()))
    moved = labels.join(top.select(F.col("node").alias("component"), F.col("component").alias("up")), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return checkpointed(moved.union(top.join(labels.select("node"), "node", "left_anti")))


def labelled(df: DataFrame, labels: DataFrame | None) -> DataFrame:
    """df with the component of its node, the node itself where it has no links."""
    if labels is None:
        return df.withColumn("component", F.col("node"))
    return df.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
