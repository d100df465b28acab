"""Deep pages of an ordered result, without the pages before them.

``OFFSET`` gathers every row before the page. Here a result that is paged through is written once,
cut into ranges of its order; a small table counts the rows of each range. Page k then lies in
one range, or in a few neighbouring ones, whose numbers are a partition filter: it reads these
ranges only and gathers its own rows only.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.session import app_folder


@dataclass(frozen=True)
class PagedResult:
    """Where an ordered result lies and how many rows each of its ranges holds. ``starts[i]`` rows stand before range i; the last entry counts all."""

    rows: DataFrame
    starts: tuple[int, ...]
    limit: int

    @property
    def total(self) -> int:
        return self.starts[-1]

    @property
    def pages(self) -> int:
        return -(-self.total // self.limit)

    def ranges_of(self, page: int) -> tuple[int, int]:
        """First and last range that hold rows of a page (from 1)."""
        first = bisect_right(self.starts, (page - 1) * self.limit) - 1
        last = bisect_right(self.starts, min(page * self.limit, self.total) - 1) - 1
        return first, last

    def page(self, page: int) -> DataFrame:
        """The rows of a page in order, with their ``position`` from 0 in the whole result; none beyond the last page."""
        first, last = self.ranges_of(page) if 1 <= page <= self.pages else (0, -1)
        low, high = (page - 1) * self.limit, page * self.limit
        near = self.rows.where(F.col("range").between(first, last))
        wanted = near.where((F.col("position") >= low) & (F.col("position") < high))
        return wanted.orderBy("position").drop("range")


def paged(result: DataFrame, order: list[Column], limit: int, path: str | None = None, ranges: int | None = None) -> PagedResult:
    """Write ``result`` in ``order``, which must tell all rows apart, and count its ranges.

    Each range is numbered inside its own task; the counts, one number a range, come to the driver,
    and the position of a row is what stands before its range plus its place there.
    """
    if limit < 1:
        raise ValueError("a page has at least one row")
    spark = result.sparkSession
    path = path or f"{app_folder(spark)}/pages-{uuid.uuid4().hex}"
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = result.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    cut.withColumn("place", place).write.partitionBy("range").parquet(path)
    schema = cut.select("*", F.lit(0).alias("place")).schema
    rows = spark.read.schema(schema).parquet(path)
    counts = {r["range"]: r["count"] for r in rows.groupBy("range").count().collect()}
    starts = tuple(accumulate((counts.get(i, 0) for i in range(max(counts, default=-1) + 1)), initial=0))
    before = F.element_at(F.array(*[F.lit(n).cast("long") for n in starts]), F.col("range") + 1)
    return PagedResult(rows.withColumn("position", before + F.col("place")).drop("place"), starts, limit)
