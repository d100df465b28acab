"""Snapshot dates of a site: neighbours, the latest, the newest k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.operators.nesting import SNAPSHOT


def snapshot_dates(members: DataFrame) -> DataFrame:
    """One row per snapshot. All windows below run on these rows, never on members."""
    return members.select(*SNAPSHOT).distinct()


def adjacent_pairs(dates: DataFrame) -> DataFrame:
    """Each snapshot with the next one of its site."""
    nxt = F.lead("snapshot_date").over(Window.partitionBy("site_id").orderBy("snapshot_date"))
    return (
        dates.select("site_id", F.col("snapshot_date").alias("from_date"), nxt.alias("to_date"))
        .where(F.col("to_date").isNotNull())
    )


def latest_dates(dates: DataFrame) -> DataFrame:
    return dates.groupBy("site_id").agg(F.max("snapshot_date").alias("snapshot_date"))


def newest_dates(dates: DataFrame, keep: int = 2) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("snapshot_date")))
    return dates.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")
