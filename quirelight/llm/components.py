"""Connected components of undirected links, by alternating large-star and small-star steps.

Each step moves links, never whole neighbour lists: a node's smallest neighbour is a partial
aggregate, and joins on nodes are between exchanges that adaptive execution can split. Lineage is
cut with reliable checkpoints. The number of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import checkpoint, dealt_again


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(dealt_again(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(dealt_again(least, "a"), "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of all nodes in ``edges`` (a, b: long);
    nodes without links are not listed."""
    edges = checkpoint(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        edges = checkpoint(_small_star(_large_star(edges)))
        # Done when every node has one link and none of its targets has one: a forest of stars.
        row = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(row) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = tuple(row)


def least_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union links a[i] - b[i] into ``labels`` in place; a label is the smallest index reachable."""
    while len(a):
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        np.minimum.at(labels, high, low)
        while True:  # shortcut to the roots
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
