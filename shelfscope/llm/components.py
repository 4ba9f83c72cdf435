"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import materialise


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and all its v in ``m``.

    The least is a partial aggregate and comes back by a join, which may be
    split where one node holds many edges.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")),
                    F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first()
    return tuple(row)


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the least node that each node with an edge can reach.

    Nodes are longs; an edge with a null or equal ends is ignored. Every round
    is written to the shared folder, and only a count and two checksums of the
    edges reach the driver.
    """
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(
        F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).distinct()
    pairs = materialise(pairs, "edges")
    before = _state(pairs)
    while before[0]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        stars = _with_least(large)
        small = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            stars.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        pairs = materialise(small, "edges")
        after = _state(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
