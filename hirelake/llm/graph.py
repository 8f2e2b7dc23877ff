"""Connected components of an edge table, by alternating star steps.

Every step is a grouped minimum (combined on the map side) and a join, so a
node with very many links is never gathered in one place; only one row of
counts a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (undirected, ids long); the
    root is the smallest id of its component.

    Nodes are pointed at the smallest neighbour in turn from both sides until
    nothing moves.  Rounds grow with the logarithm of the longest path."""
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = materialize(edges.where(F.col(a) != F.col(b)).select(high, low).distinct(), "links")
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Neighbours above a node move to the smallest one it knows.
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u > v").distinct())
        # Neighbours below a node, and the node, move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct())
        now = materialize(small, "links")
        new = _state(now)
        if new == state:
            break
        state = new
    return (now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def _state(links: DataFrame) -> tuple:
    """Count and order-free checksum of the links."""
    r = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                  F.sum(F.xxhash64("v", "u") % 1_000_003).alias("s")).first()
    return r["n"], r["x"], r["s"]
