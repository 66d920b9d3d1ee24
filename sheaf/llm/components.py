"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import stored


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node it is connected with by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): equal labels exactly if connected.

    In each round every node moves to its smallest neighbour, and edges move along. A round
    at least halves the nodes that still have edges, so there are about log2(n) of them at
    most; the driver sees counts only. A node with very many edges is combined on the map
    side when its smallest neighbour is looked for, and split by adaptive execution in the
    joins, whose other side has one row per node.
    """
    edges = stored(edges.filter("a <> b").select("a", "b"), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = stored(nodes.withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        moves = stored(
            both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("to")), "moves"
        )
        labels = stored(
            labels.join(moves.withColumnRenamed("a", "label"), "label", "left").select(
                "node", F.coalesce("to", "label").alias("label")
            ),
            "labels",
        )
        moved = edges.join(moves, "a").select(F.col("to").alias("a"), "b")
        moved = moved.join(moves.select(F.col("a").alias("b"), "to"), "b").select("a", F.col("to").alias("b"))
        edges = stored(
            moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            "edges",
        )
    return labels
