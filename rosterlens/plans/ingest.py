"""One collection run: pages in, snapshot members, profiles, run results and failures out."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.operators.extraction import PythonRule, Rule, extract_people, page_outcomes
from rosterlens.operators.identity import resolve_identity, to_members, upsert_profiles
from rosterlens.operators.nesting import SNAPSHOT, snapshot_id
from rosterlens.operators.ordered import grouped_rank
from rosterlens.operators.upkeep import HTML_EXCERPT
from rosterlens.session import stage


@dataclass
class IngestResult:
    """Tables of one run. ``runs`` feeds the registry, ``outcomes`` the failure queue."""

    members: DataFrame
    snapshots: DataFrame
    sites: DataFrame
    profiles: DataFrame
    runs: DataFrame
    outcomes: DataFrame


def ingest(
    pages: DataFrame, registry: DataFrame, sites: DataFrame, profiles: DataFrame, run_ts: dt.datetime,
    rules: list[Rule | PythonRule] | None = None,
) -> IngestResult:
    """Extract, identify and store the people of each page (url = staff page of a registered directory)."""
    remembered = F.when(~F.coalesce("rule_failed_last_time", F.lit(False)), F.col("successful_rule"))
    entry = registry.select(F.col("staff_directory").alias("url"), "base_url", remembered.alias("known_rule"))
    owner = pages.select("page_id", "url").join(entry, "url", "left")
    owner = owner.withColumn("base_url", F.coalesce("base_url", F.regexp_extract("url", r"^([^:]+://[^/?#]+)", 1)))
    owner = owner.join(sites.select("base_url", "site_id"), "base_url", "left")
    owner = owner.withColumn("site_id", F.coalesce("site_id", F.md5("base_url")))

    people = stage(extract_people(pages, rules, owner), "people")
    outcome = page_outcomes(pages, people)
    at = F.lit(run_ts).cast("timestamp")
    # A site's people in the order of its pages and of the elements on each, numbered from 0.
    owned = people.withColumnRenamed("ord", "_element").join(owner.select("page_id", "site_id"), "page_id")
    placed = grouped_rank(owned, ["site_id"], ["page_id", "_element"], out="_place").select(
        "site_id", at.alias("snapshot_date"), (F.col("_place") - 1).alias("ord"), "name", "title", "email", "phone", "category", "profile_url",
    )
    members = stage(to_members(resolve_identity(placed, profiles)), "members")

    hashes = pages.select("page_id", F.md5(F.coalesce("html", F.lit(""))).alias("hash"))  # before the shuffle: pages are large
    heads = hashes.join(owner.select("page_id", "site_id"), "page_id").groupBy("site_id").agg(F.min_by("hash", "page_id").alias("hash"))
    totals = members.groupBy(*SNAPSHOT).agg(F.count("*").alias("total_count"))
    run_id = F.unix_millis(at).cast("string").alias("run_id")
    snapshots = totals.join(heads, "site_id").select(snapshot_id().alias("snapshot_id"), *SNAPSHOT, run_id, "hash", "total_count")

    seen = snapshots.select("site_id", F.col("snapshot_id").alias("_id"), F.col("snapshot_date").alias("_at"))
    urls = owner.groupBy("site_id", "base_url").agg(F.min("url").alias("_url"))
    touched = seen.join(urls.withColumnRenamed("base_url", "_base"), "site_id")
    new_sites = sites.join(touched, "site_id", "full_outer").select(
        "site_id", F.coalesce("base_url", "_base").alias("base_url"), F.coalesce("staff_directory", "_url").alias("staff_directory"),
        F.coalesce("_at", "last_scraped_at").alias("last_scraped_at"), F.coalesce("_id", "latest_snapshot_id").alias("latest_snapshot_id"),
        F.coalesce("created_at", F.when(F.col("base_url").isNull(), F.col("_at"))).alias("created_at"),
    )

    ok = F.col("outcome") == "success"
    known = owner.select("page_id", "known_rule", "base_url")
    results = outcome.join(known, "page_id").select(
        "page_id", F.col("url").alias("staff_directory"), "base_url", at.alias("processed_at"), ok.alias("success"), "used_rule",
        "staff_count", "known_rule", F.when(~ok, F.col("outcome")).alias("failure_type"),
    )
    message = F.when(F.col("failure_type") == "fetch_failed", "Page could not be fetched").when(
        F.col("failure_type") == "no_data", "No staff data extracted"
    )
    # Only the beginning of a failed page is ever kept.
    excerpt = F.when(F.col("html").isNotNull(), F.substring("html", 1, HTML_EXCERPT)).alias("html")
    failed = results.where("not success").join(pages.select("page_id", excerpt), "page_id")
    outcomes = failed.unionByName(results.where("success").withColumn("html", F.lit(None).cast("string"))).select(
        "staff_directory", "base_url", F.col("processed_at").alias("at"), "success", "failure_type", message.alias("error_message"), "html"
    )
    return IngestResult(members, snapshots, new_sites, upsert_profiles(profiles, members), results.drop("page_id"), outcomes)
