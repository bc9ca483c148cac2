"""Connected components of an edge table, by alternating star contractions.

Both contractions keep the components: the large star links every larger
neighbour of a node to the least of its neighbourhood, the small star links
the node and its smaller neighbours to their least. The number of rounds
grows with the logarithm of the longest path, so a path of thousands of hops
takes a dozen. Each half round is one aggregation with map-side combine and
one join on the node (a node with very many neighbours is split by the skew
join); its result is a table in the shared folder and replaces the one
before. Before the first round every task contracts its own edges to a forest,
so the rounds see no more edges than a task has nodes. Two numbers for each round come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.session import cut_lineage, drop_scratch


#: edges that a task contracts at a time
SLICE = 1 << 20


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node it reaches by the given edges: the same components with fewer edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    top = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(top, high, low)  # tops hang on smaller tops, so there is no ring
        while True:
            up = top[top]
            if np.array_equal(up, top):
                break
            top = up
        a, b = top[a], top[b]
        left = a != b
        a, b = a[left], b[left]
        if len(a):
            pairs = np.unique(np.minimum(a, b) * len(nodes) + np.maximum(a, b))
            a, b = pairs // len(nodes), pairs % len(nodes)
    hang = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[hang], nodes[top[hang]]


def _contracted(batches):
    """Each slice of a task's edges, together with what is left of the ones before, becomes a forest; bounded by slice and nodes."""
    u, v, more = np.empty(0, np.int64), np.empty(0, np.int64), []
    size = 0

    def fold():
        return _forest(np.concatenate([u, *(m[0] for m in more)]), np.concatenate([v, *(m[1] for m in more)]))

    for batch in batches:
        more.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= SLICE:
            u, v = fold()
            more, size = [], 0
            if len(u) > SLICE:  # many nodes: passed on as they are
                yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])
                u, v = u[:0], v[:0]
    u, v = fold()
    yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller node."""
    least = _least(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (moved.unionByName(least.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none."""
    up = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    tops = edges.select(F.col("v").alias("top")).distinct()
    most, inner = up.join(tops, F.col("u") == F.col("top"), "left").agg(F.max("n"), F.count("top")).first()
    return (most or 0) <= 1 and inner == 0


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): each node of ``edges`` (columns u, v) with the least node it reaches.

    Self-loops and nulls are dropped, repeated and reversed edges are one.
    A node without an edge to another one does not appear. Runs until the
    edges are a forest of stars, which is the answer itself.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").cast("bigint").alias("u"), F.least("u", "v").cast("bigint").alias("v"))
    current = cut_lineage(edges.mapInArrow(_contracted, "u bigint, v bigint").distinct())
    while not _is_forest_of_stars(current):
        large = cut_lineage(_large_star(current))
        small = cut_lineage(_small_star(large))
        drop_scratch(current)
        drop_scratch(large)
        current = small
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
