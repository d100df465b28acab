"""Connected components by alternating large and small stars.

A round needs two joins on the node and halves long paths, so chains of near copies end after a
logarithmic number of rounds. Every round is written to the shared folder: a lost executor costs
tasks, not rounds. A hub with very many neighbours is a hot join key, which adaptive execution
splits because the per-node minimum is scattered first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.operators.skew import detach
from rosterlens.session import drop, stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node below the smallest of the node and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return around.where("b > a").join(detach(least), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours below the smallest of these; edges point downwards (a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(detach(least), "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """A checksum of the edge set."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(0x3FFFFFFF)), F.sum(F.shiftrightunsigned(h, 34))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; ``root`` is the smallest node of its component.

    ``edges`` has two columns of one ordered type, in any direction, with repeats. Loops and edges
    with a null end are dropped; no edges give no rows.
    """
    a, b = edges.columns
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = stage(edges, "links")
    before = _mark(edges)
    while before[0]:
        last, edges = edges, stage(_small_star(_large_star(edges)), "stars")
        after = _mark(edges)
        drop(last)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
