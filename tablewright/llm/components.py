"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Staged


def connected_components(edges: DataFrame, staged: Staged, name: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b); the root is the smallest node of the component.

    Each round hangs the larger neighbours of every node on its smallest neighbour
    (large star), then its smaller neighbours and itself (small star). Edges only ever
    get fewer or point to smaller nodes, so the rounds end, and grow with the logarithm of
    the longest path. Only two numbers a round reach the driver.
    """
    ordered = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = staged.write(ordered, f"{name}-0")
    before = _fingerprint(current)
    for k in itertools.count(1):
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()
        following = staged.write(small, f"{name}-{k}")
        staged.drop(f"{name}-{k - 1}")
        current = following
        after = _fingerprint(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]
