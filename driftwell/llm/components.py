"""Connected components of an edge list, without ever gathering links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node of its component.

    Alternating large-star and small-star steps: every node hands its neighbours to the least of
    them until all edges are stars. A logarithmic number of rounds suffices in practice, also for
    long chains. Minima are combined before the exchange and joined back, so that a
    hub of any degree is a single aggregate row, and AQE can split its side of the join. The result is a
    staged table; the tables of the rounds go as soon as the next one stands.
    """
    now = materialise(_directed(edges), "edges")
    mark = _digest(now)
    while mark[0]:
        # Large star: a node's greater neighbours move to the least of the node and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, materialise(_directed(large), "edges")
        drop(before)
        # Small star: a node and its lesser neighbours move to the least of these neighbours.
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        small = now.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        before, now = now, materialise(_directed(small), "edges")
        drop(before)
        after = _digest(now)
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("v").alias("node")).distinct()
    out = materialise(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node"))), "roots")
    drop(now)
    return out


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the greater node u to the lesser v."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _digest(edges: DataFrame) -> tuple:
    # Sums of 64-bit hashes leave the range of a long, which raises under ANSI; decimals hold them for any number of edges.
    sums = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(28,0)")), F.expr("bit_xor(xxhash64(v, u))")).first()
    return tuple(sums)
