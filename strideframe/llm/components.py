"""Connected components of an edge list, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; no group is gathered. Between rounds the edges are written to the shared
folder. After convergence every edge joins a node to the smallest node of its component.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import dropped, saved


def spanning_forest(edges: np.ndarray) -> np.ndarray:
    """A spanning forest of some edges (2 x n): each node with the least of its component."""
    ids, ends = np.unique(edges, return_inverse=True)
    a, b = ends.reshape(edges.shape)
    root = np.arange(len(ids))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    child = np.nonzero(root != np.arange(len(ids)))[0]
    return np.stack([ids[child], ids[root[child]]])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # As many edges as before; those that have become equal go in the small step.
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them. Edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node on an edge of ``edges(u, v)``, two long columns; root is the component's smallest node.

    Loops and repeated edges change nothing; an empty edge list gives an empty table. Rounds go on until nothing changes;
    their number grows with the square of the logarithm of a component's size at most.
    """
    current = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before, state = None, _state(current)
    while state[0] and state != before:
        after = saved(_small_star(_large_star(current)), "edges")
        dropped(current)
        current, before, state = after, state, _state(after)
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
