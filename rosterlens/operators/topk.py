"""The k most frequent values, exactly, without shuffling every distinct value.

A mergeable sketch of frequent items proposes k values, whose exact counts give a bound: a value that
is rarer than all of them is not wanted. Values are then counted by the bucket of their hash, a
fixed number of rows a task, and a bucket that holds fewer rows than the bound cannot hold a wanted value.
Only values of the other buckets are grouped. Whatever the sketch proposes, the result is
exact; a good proposal only leaves fewer buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACKED, BUCKETS = 10_000, 1 << 16


def frequency_bound(values: DataFrame, k: int, tracked: int = TRACKED) -> int:
    """A count that at least k values reach; 1 when there are fewer values."""
    proposed = values.agg(F.expr(f"approx_top_k(value, {int(k)}, {int(tracked)})").alias("t")).select(F.explode("t.item").alias("value"))
    counts = values.join(F.broadcast(proposed), "value").groupBy("value").agg(F.count("*").alias("n"))
    least, found = counts.agg(F.min("n"), F.count("*")).first()
    return least if found >= k else 1


def top_values(values: DataFrame, k: int, tracked: int = TRACKED, buckets: int = BUCKETS) -> DataFrame:
    """(value, count) of the k most frequent values of ``value``, ties by value; nulls do not count. No rows give none."""
    if k < 1:
        raise ValueError("k must be positive")
    rows = values.where("value is not null").select("value")
    bound = frequency_bound(rows, k, tracked)
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)))
    open_ = bucketed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= bound).select("bucket")
    counts = bucketed.join(F.broadcast(open_), "bucket", "left_semi").groupBy("value").agg(F.count("*").alias("count"))
    return counts.where(F.col("count") >= bound).orderBy(F.desc("count"), "value").limit(k)
