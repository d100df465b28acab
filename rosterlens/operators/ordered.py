"""Row numbers and carried values in groups of any size.

A window over a whole group puts that group into one task. Here all rows are cut into ranges of
equal size by group and order together, a large group into many; each range is a task-sized window
of its own, and only one summary row per range and group takes part in the window over the group.
How sparse the order is does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.operators.skew import detach
from rosterlens.session import stage

# An order position that none reaches.
END = 2**62


def _cut(df: DataFrame, keys: list[str], order: list[str], ranges: int | None) -> DataFrame:
    """``df`` with its range number ``_range``. It is written out: ranges are of one sample, however often they are read."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _columns(order: str | list[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def grouped_rank(df: DataFrame, keys: list[str], order: str | list[str], out: str = "rank", ranges: int | None = None) -> DataFrame:
    """1-based position of each row in its group; ``order`` is unique in the group."""
    order = _columns(order)
    cut = _cut(df, keys, order, ranges)
    sizes = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return (
        cut.withColumn("_local", local)
        .join(offsets, [*keys, "_range"])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_range", "_local", "_before")
    )


def carry_last(
    df: DataFrame, keys: list[str], order: str | list[str], value: Column, out: str, ranges: int | None = None
) -> DataFrame:
    """The newest non-null ``value`` at or before each row of its group, in ``order``."""
    order = _columns(order)
    cut = _cut(df.withColumn("_value", value), keys, order, ranges)
    last = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
    spans = cut.groupBy(*keys, "_range").agg(last.alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    inside = (
        Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        cut.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
        .join(spans, [*keys, "_range"])
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .drop("_range", "_value", "_inside", "_carried")
    )


def running_sum(
    df: DataFrame, keys: list[str], order: str | list[str], value: Column, out: str, ranges: int | None = None
) -> DataFrame:
    """The sum of ``value`` at and before each row of its group, in ``order``."""
    order = _columns(order)
    cut = _cut(df.withColumn("_value", value), keys, order, ranges)
    sums = cut.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # A group inside one range, as most are, has nothing before it; only those over several ranges are joined.
    spans = sums.withColumn("_before", F.sum("_sum").over(earlier)).where("_before <> 0").drop("_sum")
    inside = (
        Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        cut.withColumn("_inside", F.sum("_value").over(inside))
        .join(spans, [*keys, "_range"], "left")
        .withColumn(out, F.coalesce("_before", F.lit(0)) + F.col("_inside"))
        .drop("_range", "_value", "_inside", "_before")
    )


def keep_first(df: DataFrame, keys: list[str | Column], order: str) -> DataFrame:
    """First row of each key in ``order``: a combinable aggregate, so a hot key costs no more than a cold one."""
    row = F.struct(*[F.col(c) for c in df.columns])
    named = [k if isinstance(k, Column) else F.col(k) for k in keys]
    grouped = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(named)])
    return grouped.agg(F.min_by(row, F.col(order)).alias("_row")).select("_row.*")


def _cover_nodes(low: Column, high: Column, levels: Column) -> Column:
    """Binary-tree nodes (level, index) whose ranges together make up (low, high]."""
    start = F.struct(
        (low + 1).alias("l"), (high + 1).alias("r"), F.array().cast("array<struct<level:int,node:bigint>>").alias("out")
    )

    def node(level: Column, index: Column) -> Column:
        return F.array(F.struct(level.alias("level"), index.alias("node")))

    def climb(acc: Column, level: Column) -> Column:
        none = F.array().cast("array<struct<level:int,node:bigint>>")
        open_ = acc["l"] < acc["r"]
        left = open_ & (acc["l"] % 2 == 1)
        right = open_ & (acc["r"] % 2 == 1)
        return F.struct(
            F.shiftright(acc["l"] + left.cast("bigint"), 1).alias("l"),
            F.shiftright(acc["r"] - right.cast("bigint"), 1).alias("r"),
            F.concat(
                acc["out"],
                F.when(left, node(level, acc["l"])).otherwise(none),
                F.when(right, node(level, acc["r"] - 1)).otherwise(none),
            ).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(0), levels), start, climb, lambda acc: acc["out"])


def smallest_cover(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """For each point (keys, ord) the smallest ``owner`` among intervals (keys, low, high, owner) around it.

    Range-joining a key with many points and many intervals would meet every pair. Intervals are
    cut into tree nodes, each node keeps its smallest owner, and a point looks up the nodes above it.
    Keys with a single interval take a plain equi-join.
    """
    per_key = intervals.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct("low", "high", "owner")).alias("_i"))
    single = per_key.where("_n = 1").select(*keys, "_i.*")
    direct = points.join(detach(single), keys).where("low < ord and ord <= high").select(*points.columns, "owner")

    # The tree of a key is as high as its last point needs.
    last = points.groupBy(*keys).agg(F.max("ord").alias("_last"))
    many = per_key.where("_n > 1").select(*keys).join(last, keys)
    levels = F.ceil(F.log2(F.col("_last") + 2)).cast("int")
    nodes = (
        intervals.join(many, keys)
        .where("low < _last")
        .select(*keys, "owner", F.explode(_cover_nodes(F.col("low"), F.least("high", "_last"), levels)).alias("c"))
        .groupBy(*keys, "c.level", "c.node")
        .agg(F.min("owner").alias("owner"))
    )
    above = F.transform(
        F.sequence(F.lit(0), levels),
        lambda level: F.struct(level.alias("level"), F.call_function("shiftright", F.col("ord"), level).alias("node")),
    )
    looked_up = (
        points.join(detach(many), keys)
        .withColumn("c", F.explode(above))
        .select(*points.columns, "c.level", "c.node")
        .hint("merge")
        .join(nodes, [*keys, "level", "node"])
        .groupBy(*points.columns)
        .agg(F.min("owner").alias("owner"))
    )
    return direct.unionByName(looked_up)
