"""Connected components by pointer jumping.

Every node points to a smaller one. A round hooks the target of each node to the smallest target
among the node's neighbours, then lets every node point where its target points. Distances halve,
so a chain of n nodes is done in about log2(n) rounds, each of them joins on node keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.operators.skew import detach
from rosterlens.session import drop, stage


def _jump(points: DataFrame) -> DataFrame:
    """Every node points where its target points."""
    beyond = points.select(F.col("node").alias("root"), F.col("root").alias("_beyond"))
    return points.join(detach(beyond), "root").select("node", F.col("_beyond").alias("root"))


def label_components(edges: DataFrame) -> DataFrame:
    """(node, root) for rows (a, b): ``root`` is the smallest node of the component. Loops keep a lone node; no edges give no rows."""
    both = stage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both-ways")
    points = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "pointers")
    while True:
        targets = points.select(F.col("node").alias("b"), F.col("root").alias("_near"))
        nearest = both.join(detach(targets), "b").groupBy(F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        seen = stage(points.join(nearest, "node").select("node", "root", F.least("root", "_near").alias("_low")), "seen")
        # the node itself and the node it points to both learn of the smaller target
        told = seen.select("node", "_low").unionByName(seen.select(F.col("root").alias("node"), "_low")).groupBy("node").agg(F.min("_low").alias("root"))
        hooked = stage(_jump(stage(told, "hooked")), "pointers")
        moved = hooked.join(points.withColumnRenamed("root", "_old"), "node").where("root <> _old")
        done = moved.isEmpty()
        drop(points)
        points = hooked
        if done:
            return points
