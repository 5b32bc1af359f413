"""Connected components of links too many for one machine, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.durable import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For every node of a link between different nodes: (node, component), component the smallest node it reaches.

    links: two columns of one integer type.  Null ends, links of a node to itself, repeated and reversed links are
    allowed and change nothing; no links give no rows.  Every step keeps one row per link at most, sums before each
    shuffle, and leaves hot nodes to adaptive skew joins; nothing but a count and a checksum comes to the driver.
    The number of rounds grows with the logarithm of the longest path.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = cut(ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if (now.n, now.s) == before or not now.n:
            break
        before = now.n, now.s
        small = now.n <= BROADCAST_ROWS
        edges = cut(_small_star(_large_star(edges, small), small))
    return edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between values: as few links that join the same values, each to the smallest of its group."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


#: Links up to which what is smallest at each node, two numbers a row and no more rows than links, is broadcast.
BROADCAST_ROWS = 500_000


def _least(edges: DataFrame, node: str, small: bool) -> DataFrame:
    least = edges.groupBy(F.col("hi").alias(node)).agg(F.min("lo").alias("least"))
    return F.broadcast(least) if small else least


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    """Each link's smaller end gives way to the smallest node next to it."""
    return (
        edges.join(_least(edges, "lo", small), "lo", "left")
        .select("hi", F.coalesce("least", "lo").alias("lo"))
        .distinct()
    )


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    least = _least(edges, "hi", small)
    others = edges.join(least, "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return others.unionByName(least.select("hi", F.col("least").alias("lo"))).distinct()
