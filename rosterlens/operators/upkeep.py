"""Upserts, retention, resets, rollbacks. Each job computes the new table; writing it is the caller's step."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.text import in_local_month, truncate
from rosterlens.operators.nesting import SNAPSHOT, snapshot_id
from rosterlens.operators.registry import registry_of_sites
from rosterlens.operators.skew import detach
from rosterlens.operators.snapshots import newest_dates, snapshot_dates

HTML_EXCERPT = 5000
HTML_SNIPPET = 200
ERROR_TEXT = 500


def keep_newest(members: DataFrame, keep: int = 2) -> DataFrame:
    """Members of the newest ``keep`` snapshots of each site."""
    return members.join(newest_dates(snapshot_dates(members), keep), SNAPSHOT, "left_semi")


def drop_dangling_logs(change_log: DataFrame, dates: DataFrame) -> DataFrame:
    """Change logs whose two snapshots both still exist."""
    for date in ("from_date", "to_date"):
        known = dates.select("site_id", F.col("snapshot_date").alias(date))
        change_log = change_log.join(known, ["site_id", date], "left_semi")
    return change_log


def update_failures(failed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Failure queue after a batch of outcomes (staff_directory, base_url, at, success, failure_type, error_message, html).

    A success clears the directory; failures after it count anew. Attempts add up, the newest failure gives the texts.
    """
    cleared = outcomes.where("success").groupBy("staff_directory").agg(F.max("at").alias("_cleared"))
    fresh = outcomes.where("not success").join(detach(cleared), "staff_directory", "left").where("_cleared is null or at > _cleared")
    fresh = fresh.select(
        "staff_directory", "base_url", "failure_type", truncate(F.col("error_message"), ERROR_TEXT).alias("error_message"),
        truncate(F.col("html"), HTML_EXCERPT).alias("html_excerpt"), F.col("at").alias("last_attempt"),
        F.lit(1).cast("bigint").alias("attempt_count"),
    )
    kept = failed.join(cleared, "staff_directory", "left_anti").select(*fresh.columns)
    texts = ["base_url", "failure_type", "error_message", "html_excerpt"]
    merged = kept.unionByName(fresh).groupBy("staff_directory").agg(
        F.max(F.struct("last_attempt", *texts)).alias("v"), F.max("last_attempt").alias("last_attempt"),
        F.sum("attempt_count").alias("attempt_count"),
    )
    return merged.select("staff_directory", *[f"v.{c}" for c in texts], "last_attempt", "attempt_count")


def list_failures(failed: DataFrame) -> DataFrame:
    """Failures, newest first, with a short piece of the page."""
    snippet = F.when(F.col("html_excerpt") != "", F.concat(truncate(F.col("html_excerpt"), HTML_SNIPPET), F.lit("...")))
    return failed.withColumn("html_snippet", snippet).drop("html_excerpt").orderBy(F.desc("last_attempt"), "staff_directory")


def update_challenge_sites(known: DataFrame, detections: DataFrame) -> DataFrame:
    """Challenge-page tracking after detections (staff_directory, base_url, at, method)."""
    fresh = detections.groupBy("staff_directory").agg(
        F.max(F.struct("at", "base_url")).alias("_b"), F.min("at").alias("first_detected"), F.max("at").alias("last_detected"),
        F.count("*").alias("detection_count"), F.lit(False).alias("always_protected"),
        F.max(F.when(F.col("method").isNotNull(), F.struct("at", "method"))).alias("_m"),
    )
    fresh = fresh.withColumn("base_url", F.col("_b.base_url")).withColumn("last_success_with", F.col("_m.method")).drop("_b", "_m")
    both = known.select(*fresh.columns).unionByName(fresh)
    merged = both.groupBy("staff_directory").agg(
        F.max(F.struct("last_detected", "base_url")).alias("_b"), F.min("first_detected").alias("first_detected"),
        F.max("last_detected").alias("last_detected"), F.sum("detection_count").alias("detection_count"),
        F.max("always_protected").alias("always_protected"),
        F.max(F.when(F.col("last_success_with").isNotNull(), F.struct("last_detected", "last_success_with"))).alias("_m"),
    )
    return merged.withColumn("base_url", F.col("_b.base_url")).withColumn("last_success_with", F.col("_m.last_success_with")).select(*known.columns)


def reset_sites(tables: dict[str, DataFrame], reset: DataFrame) -> dict[str, DataFrame]:
    """All tables without the data of the ``reset`` sites (site_id, base_url, staff_directory)."""
    new = {
        name: tables[name].join(reset.select("site_id"), "site_id", "left_anti")
        for name in ("members", "profiles", "change_log", "entries")
        if name in tables
    }
    if "failed" in tables:
        new["failed"] = tables["failed"].join(reset.select("staff_directory"), "staff_directory", "left_anti")
    if "directories" in tables:
        hit = registry_of_sites(tables["directories"], reset).select("staff_directory", F.lit(True).alias("_hit"))
        new["directories"] = (
            tables["directories"].join(hit, "staff_directory", "left")
            .withColumn("successful_rule", F.when(F.col("_hit").isNull(), F.col("successful_rule")))
            .withColumn("rule_failed_last_time", F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("rule_failed_last_time")))
            .select(*tables["directories"].columns)
        )
    if "sites" in tables:
        hit = reset.select("site_id", F.lit(True).alias("_hit"))
        new["sites"] = (
            tables["sites"].join(hit, "site_id", "left")
            .withColumns({c: F.when(F.col("_hit").isNull(), F.col(c)) for c in ("latest_snapshot_id", "last_scraped_at")})
            .select(*tables["sites"].columns)
        )
    return new


def delete_by_rule(tables: dict[str, DataFrame], rule: str, expected: int) -> dict[str, DataFrame]:
    """Remove the directories remembered under one rule and all their data, if exactly ``expected`` are found."""
    doomed = tables["directories"].where(F.col("successful_rule") == rule)
    found = doomed.count()
    if found != expected:
        raise ValueError(f"expected {expected} directories with rule {rule}, found {found}")
    sites = tables["sites"]
    by_base = sites.join(doomed.select("base_url"), "base_url", "left_semi")
    by_page = sites.join(doomed.select("staff_directory"), "staff_directory", "left_semi")
    reset = by_base.unionByName(by_page).dropDuplicates(["site_id"])
    new = reset_sites({k: v for k, v in tables.items() if k not in ("directories", "sites")}, reset)
    new["directories"] = tables["directories"].join(doomed.select("staff_directory"), "staff_directory", "left_anti")
    new["sites"] = sites.join(reset.select("site_id"), "site_id", "left_anti").select(*sites.columns)
    return new


def rollback_month(
    tables: dict[str, DataFrame], year: int, month: int, back_to: dt.datetime, tz: str = "America/New_York"
) -> dict[str, DataFrame]:
    """Undo everything that was created in one local month, and point each site at its latest remaining snapshot."""

    def inside(c: str) -> Column:
        return in_local_month(F.col(c), year, month, tz)

    new = {
        "members": tables["members"].where(~inside("snapshot_date")),
        "change_log": tables["change_log"].where(~inside("created_at")),
        "profiles": tables["profiles"].where(~inside("first_seen_at")),
    }
    new["directories"] = tables["directories"].withColumn(
        "last_processed_at",
        F.when(F.col("is_active") & inside("last_processed_at"), F.lit(back_to)).otherwise(F.col("last_processed_at")),
    )
    new["sites"] = repoint_sites(tables["sites"], snapshot_dates(new["members"]))
    return new


def repoint_sites(sites: DataFrame, dates: DataFrame) -> DataFrame:
    """Latest-snapshot pointers from the snapshots that exist; the scrape date moves only with the pointer."""
    latest = dates.groupBy("site_id").agg(F.max("snapshot_date").alias("_date"))
    latest = latest.withColumn("_id", snapshot_id("site_id", "_date"))
    moved = ~F.col("latest_snapshot_id").eqNullSafe(F.col("_id"))
    return (
        sites.join(latest, "site_id", "left")
        .withColumn("last_scraped_at", F.when(moved, F.col("_date")).otherwise(F.col("last_scraped_at")))
        .withColumn("latest_snapshot_id", F.col("_id"))
        .select(*sites.columns)
    )
