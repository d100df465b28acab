"""Pages about sites and their changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.text import blank_to_null
from rosterlens.operators.nesting import SNAPSHOT
from rosterlens.operators.snapshots import latest_dates, snapshot_dates
from rosterlens.plans.search import contains

COUNTS = ["added_count", "removed_count", "updated_count"]


def list_sites(sites: DataFrame, search: str | None = None) -> DataFrame:
    if not search:
        return sites
    return sites.where(contains(F.col("base_url"), search) | contains(F.col("staff_directory"), search))


def sites_with_changes(change_log: DataFrame, sites: DataFrame, search: str | None = None) -> DataFrame:
    """Sites that have change logs, with their number and the newest date. Counts come before the join."""
    per_site = change_log.groupBy("site_id").agg(F.count("*").alias("change_count"), F.max("created_at").alias("last_change"))
    return list_sites(sites, search).join(per_site, "site_id")


def site_statistics(change_log: DataFrame, site_id: str) -> DataFrame:
    """Totals of one site, zeros when it has no log."""
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c.replace("_count", "_total")) for c in COUNTS]
    return change_log.where(F.col("site_id") == site_id).agg(F.count("*").alias("changes"), *totals)


def all_site_statistics(change_log: DataFrame) -> DataFrame:
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c.replace("_count", "_total")) for c in COUNTS]
    return change_log.groupBy("site_id").agg(F.count("*").alias("changes"), *totals)


def array_totals(change_docs: DataFrame) -> DataFrame:
    """Totals over change documents that hold their entries as arrays; a missing array counts as empty."""
    totals = [
        F.coalesce(F.sum(F.when(F.col(k).isNotNull(), F.size(k)).otherwise(0)), F.lit(0)).alias(f"{k}_total")
        for k in ("added", "removed", "updated")
    ]
    return change_docs.agg(F.count("*").alias("changes"), *totals)


def recent_changes(change_log: DataFrame, site_id: str | None = None, limit: int = 10) -> DataFrame:
    logs = change_log if site_id is None else change_log.where(F.col("site_id") == site_id)
    return logs.orderBy(F.desc("created_at"), F.desc("change_id")).limit(limit)


def display_name(name: Column, title: Column, before: Column | None = None, after: Column | None = None) -> Column:
    """First of name, alternatives and title that is set, else ``Unknown``."""
    options = [name, title] if before is None else [name, before, after]
    return F.coalesce(*[blank_to_null(c) for c in options], F.lit("Unknown"))


def diff_side(side: str) -> Column:
    """Name value on one side of the name diff, if the entry has one."""
    found = F.filter(F.col("diffs"), lambda d: d["field"] == "name")
    return F.try_element_at(F.try_element_at(found, F.lit(1))[side], F.lit(1))


def site_changes(change_log: DataFrame, entries: DataFrame, site_id: str, limit: int = 10) -> DataFrame:
    """Entries of the newest ``limit`` logs of one site, with dates and counts."""
    logs = recent_changes(change_log, site_id, limit)
    name = F.when(
        F.col("kind") == "updated",
        display_name(F.col("name"), F.col("title"), diff_side("before"), diff_side("after")),
    ).otherwise(display_name(F.col("name"), F.col("title")))
    mine = entries.where(F.col("site_id") == site_id) if "site_id" in entries.columns else entries
    detail = mine.select(
        "change_id", "kind", "ord", "fingerprint", name.alias("name"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), "diffs",
    )
    return logs.join(detail, "change_id", "left")


def sample_changes(change_log: DataFrame, n: int = 1, seed: int = 0) -> DataFrame:
    """Logs that have both snapshots, in an order that the seed shuffles: the same ones on every run."""
    both = F.col("from_date").isNotNull() & F.col("to_date").isNotNull()
    place = F.md5(F.concat_ws("|", "change_id", F.lit(str(seed))).cast("binary"))
    return change_log.where(both).orderBy(place, "change_id").limit(n)


def site_profile_counts(sites: DataFrame, profiles: DataFrame) -> DataFrame:
    counts = profiles.groupBy("site_id").agg(F.count("*").alias("n"))
    return sites.join(counts, "site_id", "left").withColumn("profile_count", F.coalesce("n", F.lit(0))).drop("n")


def latest_snapshot(members: DataFrame) -> DataFrame:
    """Members of the latest snapshot of every site."""
    return members.join(latest_dates(snapshot_dates(members)), SNAPSHOT, "left_semi")


def table_counts(**tables: DataFrame) -> DataFrame:
    """Row counts of several tables as (table, n)."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result
