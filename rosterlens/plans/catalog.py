"""All registered queries: name -> (spark, sf_dir) -> DataFrame of flat columns."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens import schemas
from rosterlens.functions import contacts, names, text, urls
from rosterlens.operators import compare, extraction, flatten, identity, nesting, ordered, registry, similar, snapshots, sql_rules, table_roles, topk, upkeep
from rosterlens.plans import changes, dashboard, export, paging, search
from rosterlens.plans import standins as s
from rosterlens.plans.ingest import ingest
from rosterlens.session import app_folder, stage
from rosterlens.sources.elements import page_elements
from rosterlens.streaming.intake import Intake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def day(c: str = "snapshot_date") -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def second(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def listed(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


# Snapshots and comparison


@query
def snapshot_rollup(spark, sf_dir):
    rows = nesting.snapshot_counts(s.members(spark, sf_dir))
    shown = F.array_join(F.transform("categories", lambda c: F.concat(c["category"], F.lit(":"), c["count"].cast("string"))), ", ")
    return rows.select("site_id", day(), "total_count", shown.alias("categories"))


@query
def nested_sections(spark, sf_dir):
    sections = nesting.nest(s.members(spark, sf_dir), section_size=20)
    return sections.select(
        "site_id", day(), "category", "section", "cat_ord", "count", F.size("members").cast("bigint").alias("members"),
        F.try_element_at(F.col("members.ord"), F.lit(1)).alias("first_ord"),
    )


@query
def person_categories(spark, sf_dir):
    return nesting.person_rows(s.members(spark, sf_dir)).select("site_id", day(), "fingerprint", "ord", "title", listed("categories"))


@query
def adjacent_pairs(spark, sf_dir):
    return snapshots.adjacent_pairs(snapshots.snapshot_dates(s.members(spark, sf_dir))).select("site_id", day("from_date"), day("to_date"))


@query
def fingerprint_diff(spark, sf_dir):
    rows = compare.compare_by_fingerprint(s.members(spark, sf_dir))
    return rows.select(
        "site_id", day("from_date"), day("to_date"), "kind", "fingerprint", "name", export.change_code().alias("change_code"),
        export.change_details().alias("change_details"),
    )


@query
def change_log_counts(spark, sf_dir):
    log = changes.build_change_log(compare.compare_by_fingerprint(s.members(spark, sf_dir)))
    return log.select("site_id", day("from_date"), day("to_date"), "added_count", "removed_count", "updated_count")


@query
def side_by_side(spark, sf_dir):
    members = s.members(spark, sf_dir)
    dates = snapshots.snapshot_dates(members)
    pairs = snapshots.adjacent_pairs(snapshots.newest_dates(dates, 2))
    rows = compare.side_by_side(members, compare.compare_by_fingerprint(members.join(snapshots.newest_dates(dates, 2), nesting.SNAPSHOT, "left_semi")), pairs)
    return rows.select("site_id", "side", "ord", "fingerprint", "category", "is_added", "is_removed", "is_updated")


@query
def retention_keep2(spark, sf_dir):
    return upkeep.keep_newest(s.members(spark, sf_dir), 2).select("site_id", day(), "ord", "fingerprint")


@query
def retention_cascade(spark, sf_dir):
    """Snapshots = order dates of a customer, logs = neighbouring dates; logs of dropped dates go."""
    dates = s.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("site_id"), F.col("o_orderdate").alias("snapshot_date")
    ).distinct()
    logs = snapshots.adjacent_pairs(dates)
    return upkeep.drop_dangling_logs(logs, snapshots.newest_dates(dates, 3)).select("site_id", day("from_date"), day("to_date"))


@query
def latest_snapshot(spark, sf_dir):
    return dashboard.latest_snapshot(s.members(spark, sf_dir)).select("site_id", day(), "ord", "fingerprint", "category")


# Identity and matching


@query
def identity_resolve(spark, sf_dir):
    """Even customers are known profiles, odd ones arrive; neighbours share site, name and perhaps email."""
    key, pair = F.col("c_custkey"), F.floor(F.col("c_custkey") / 2)
    rows = s.table(spark, sf_dir, "customer").select(
        (pair % 10).cast("string").alias("site_id"), F.lit("2024-01-01").cast("timestamp").alias("snapshot_date"),
        key.alias("ord"), F.concat(F.lit("Customer "), pair).alias("name"),
        F.when(F.col("c_acctbal") >= 2000, F.concat(F.lit("C"), pair, F.lit("@site.test"))).alias("email"),
    )
    known = rows.where("ord % 2 = 0").select(
        "site_id", F.concat(F.lit("known-"), "ord").alias("fingerprint"), F.col("name").alias("canonical_name"),
        F.when(F.col("email").isNotNull(), F.array("email")).otherwise(F.array().cast("array<string>")).alias("emails"),
        F.col("snapshot_date").alias("last_seen_at"),
    )
    return identity.resolve_identity(rows.where("ord % 2 = 1"), known).select("site_id", "ord", "fingerprint")


@query
def profile_upsert(spark, sf_dir):
    """Profiles of the first half of the month, then the second half arrives."""
    members = s.members(spark, sf_dir)
    middle = F.lit("2024-01-15").cast("timestamp")
    old = identity.profiles_from(members.where(F.col("snapshot_date") < middle))
    rows = identity.upsert_profiles(old, members.where(F.col("snapshot_date") >= middle))
    return rows.select(
        "site_id", "fingerprint", "canonical_name", "title", listed("emails"), listed("phones"), day("first_seen_at"),
        day("last_seen_at"), listed("categories"),
    )


@query
def flatten_name_title(spark, sf_dir):
    people = flatten.flatten_people(s.part_people(spark, sf_dir, with_email=False))
    return people.select("site_id", "ord", "fingerprint", "name", "title", listed("categories"))


@query
def flatten_people(spark, sf_dir):
    people = flatten.flatten_people(s.part_people(spark, sf_dir, with_email=True))
    return people.select("site_id", "ord", "fingerprint", "name", "title", listed("categories"))


def _customer_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = s.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("site_id"), F.col("c_mktsegment").alias("segment"), F.lower("c_name").alias("v"),
        F.col("c_custkey").alias("ord"),
    )
    return rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1").withColumnRenamed("v", "w")


@query
def exact_link(spark, sf_dir):
    """Several people on each side hold one email or one URL; a URL may end in a slash."""
    key = F.col("c_custkey")
    email = F.array(F.concat(F.lit("mailto:C"), F.floor(key / 6), F.lit("@Site.test ")))
    rows = s.table(spark, sf_dir, "customer").select(
        (F.floor(key / 60) % 10).cast("string").alias("site_id"), F.lit("2024-01-01").cast("timestamp").alias("from_date"),
        F.lit("2024-02-01").cast("timestamp").alias("to_date"), key.alias("ord"),
        F.when(F.col("c_acctbal") >= 2000, email).otherwise(F.array().cast("array<string>")).alias("emails"),
        F.when(key % 5 != 0, F.concat(F.lit("https://site.test/p/"), F.floor(key / 8), F.when(key % 3 == 0, "/").otherwise(""))).alias("profile_url"),
    )
    return compare.sure_links(rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1")).select("site_id", "b", "a")


@query
def fuzzy_candidates(spark, sf_dir):
    left, right = _customer_sides(spark, sf_dir)
    pairs = similar.similar_names(left, right, ["site_id", "segment"])
    return pairs.select("site_id", "segment", "v", "w", F.round("score", 6).alias("score"))


@query
def fuzzy_best(spark, sf_dir):
    """Best candidate per name; equal scores go to the lower name, which is the lower position."""
    left, right = _customer_sides(spark, sf_dir)
    pairs = similar.similar_names(left, right, ["site_id", "segment"])
    best = pairs.groupBy("site_id", "segment", "v").agg(F.min_by(F.struct("w", "score"), F.struct(-F.col("score"), F.col("w"))).alias("b"))
    return best.select("site_id", "segment", "v", "b.w", F.round("b.score", 6).alias("score"))


@query
def fuzzy_compare(spark, sf_dir):
    rows = compare.compare_fuzzy(s.customer_snapshots(spark, sf_dir))
    return rows.select(
        "site_id", day("from_date"), day("to_date"), "kind", "ord", "fingerprint", "name", "title",
        export.change_code().alias("change_code"), export.change_details().alias("change_details"),
    )


# Search and dashboards


def _search_result(people: DataFrame) -> DataFrame:
    where = F.array_join(F.transform("sites", lambda x: F.concat(x["site_id"], F.lit("@"), F.date_format(x["snapshot_date"], "yyyy-MM-dd"))), ",")
    return people.select(
        "fingerprint", "name", "title", listed("emails"), listed("phones"), "category", where.alias("sites"), day("latest_seen"), day("first_seen")
    )


USER_SEARCH = {"name": "user 1", "email": "SITE.test", "phone": "555 010", "title": "grade", "category": "click"}


@query
def staff_search(spark, sf_dir):
    page = search.search_page(s.members(spark, sf_dir), s.sites(spark, sf_dir), page=1, limit=20, **USER_SEARCH)
    return _search_result(page.rows)


@query
def search_totals(spark, sf_dir):
    return search.totals(search.people_of(search.sightings(s.members(spark, sf_dir), s.sites(spark, sf_dir), **USER_SEARCH)), page=2, limit=20)


@query
def search_sightings(spark, sf_dir):
    """Where every person of one category was seen, flat."""
    seen = search.sightings(s.members(spark, sf_dir), s.sites(spark, sf_dir), category="SIGN", category_scope="member")
    return seen.select("fingerprint", "site_id", day("snapshot_date"), F.col("p.name").alias("name"))


@query
def search_page_after(spark, sf_dir):
    """The page behind a given last person, without the pages before it."""
    people = search.people_of(search.sightings(s.members(spark, sf_dir), s.sites(spark, sf_dir), category="SIGN", category_scope="member"))
    return search.page_after(people, "2024-01-20", "8", 25).select("fingerprint", "name", day("latest_seen"), "sightings")


@query
def staff_search_exact(spark, sf_dir):
    return _search_result(search.search_people(s.members(spark, sf_dir), s.sites(spark, sf_dir), name="User 7", site="nation_7", exact=True))


@query
def search_category_scope(spark, sf_dir):
    people = search.search_people(s.members(spark, sf_dir), s.sites(spark, sf_dir), category="SIGN", category_scope="member")
    return _search_result(people)


@query
def suggestions(spark, sf_dir):
    return search.suggest(s.part_people(spark, sf_dir, with_email=False), "ri", "name")


@query
def site_list(spark, sf_dir):
    rows = dashboard.list_sites(s.sites(spark, sf_dir), "Nation_1")
    return search.page_rows(rows.select("site_id", "base_url", "staff_directory"), ["site_id"], page=1, limit=5)


@query
def sites_with_changes(spark, sf_dir):
    rows = dashboard.sites_with_changes(s.change_log(spark, sf_dir), s.sites(spark, sf_dir), "nation")
    page = search.page_rows(rows, [F.desc("last_change"), "site_id"], page=1, limit=20)
    return page.select("site_id", "base_url", "staff_directory", "change_count", day("last_change"))


@query
def site_change_stats(spark, sf_dir):
    return dashboard.all_site_statistics(s.counted_change_log(spark, sf_dir))


@query
def site_change_page(spark, sf_dir):
    rows = dashboard.site_changes(s.counted_change_log(spark, sf_dir), s.entries(spark, sf_dir), "3", 10)
    return rows.select(
        "change_id", day("created_at"), day("from_date"), day("to_date"), "added_count", "removed_count", "updated_count", "kind",
        "ord", "fingerprint", "name", listed("categories"),
    )


@query
def recent_changes(spark, sf_dir):
    rows = dashboard.recent_changes(s.change_log(spark, sf_dir), None, 10)
    return rows.select("change_id", "site_id", day("created_at"))


@query
def sample_changes(spark, sf_dir):
    return dashboard.sample_changes(s.change_log(spark, sf_dir), 5, seed=11).select("change_id", "site_id", day("created_at"))


@query
def site_profile_counts(spark, sf_dir):
    rows = dashboard.site_profile_counts(s.sites(spark, sf_dir), s.profiles(spark, sf_dir))
    return rows.select("site_id", "base_url", "profile_count").orderBy("base_url")


@query
def table_counts(spark, sf_dir):
    return dashboard.table_counts(
        members=s.members(spark, sf_dir), profiles=s.profiles(spark, sf_dir), change_log=s.change_log(spark, sf_dir), entries=s.entries(spark, sf_dir)
    )


# Exports


@query
def export_full(spark, sf_dir):
    rows = export.export_profiles(s.profiles(spark, sf_dir), s.sites(spark, sf_dir), s.registry(spark, sf_dir))
    return rows.withColumn("last_updated", day("last_updated"))


@query
def export_school(spark, sf_dir):
    rows = export.export_schools(s.profiles(spark, sf_dir), s.sites(spark, sf_dir), s.registry(spark, sf_dir))
    return rows.withColumn("last_updated", day("last_updated"))


@query
def export_changes(spark, sf_dir):
    rows = export.export_changes(s.entries(spark, sf_dir), s.change_log(spark, sf_dir), s.sites(spark, sf_dir), s.registry(spark, sf_dir))
    return rows.withColumn("change_date", day("change_date"))


@query
def export_recent_changes(spark, sf_dir):
    rows = export.export_recent_changes(s.entries(spark, sf_dir), s.change_log(spark, sf_dir), s.sites(spark, sf_dir), s.registry(spark, sf_dir))
    return rows.withColumn("change_date", day("change_date"))


@query
def export_summary(spark, sf_dir):
    sites = s.sites(spark, sf_dir).where("site_id <> '3'")  # logs of a site that is gone
    return export.export_summary(s.entries(spark, sf_dir), s.change_log(spark, sf_dir), sites)


@query
def change_quality(spark, sf_dir):
    rows = export.school_changes(s.entries(spark, sf_dir), s.change_log(spark, sf_dir), s.sites(spark, sf_dir), s.registry(spark, sf_dir))
    return export.change_quality(rows)


@query
def export_audit(spark, sf_dir):
    """Daily changes of all sites, exported and checked against their logs and snapshots."""
    members = s.members(spark, sf_dir)
    entries = stage(compare.compare_by_fingerprint(members), "entries")
    exported = entries.select(export.change_code().alias("change_type"), F.col("fingerprint").alias("unique_id")).distinct()
    rows = export.audit_export(exported, entries, changes.build_change_log(entries), members)
    return rows.select("change_type", "unique_id", "in_from", "in_to", "verdict")


@query
def export_manifest(spark, sf_dir):
    """Each order is an export: known ones are even, new ones odd; then those older than a week expire."""
    rows = s.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("export-"), "o_orderkey").alias("filename"),
        F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_orderstatus") == "O", "changes").otherwise("university").alias("file_type"),
        F.col("o_custkey").cast("string").alias("site_id"), F.floor("o_totalprice").cast("bigint").alias("record_count"),
        F.col("o_orderdate").cast("timestamp").alias("generated_at"), F.col("o_orderkey").alias("k"),
    )
    known = rows.where("k % 2 = 0").withColumn("expires_at", F.col("generated_at") + F.expr("INTERVAL 7 DAYS")).withColumn("is_active", F.lit(True))
    manifest = export.register_export(known, rows.where("k % 2 = 1 or k % 10 = 0").drop("k"))
    aged = export.expire_exports(manifest, F.lit("1999-01-01").cast("timestamp"))
    return aged.select("filename", "file_type", "record_count", day("generated_at"), day("expires_at"), "is_active")


# Registry


@query
def due_list(spark, sf_dir):
    rows = registry.due_list(s.run_registry(spark, sf_dir), F.lit(s.NOW).cast("timestamp"))
    return rows.select("staff_directory", "rule", second("last_processed_at"))


@query
def month_status(spark, sf_dir):
    return registry.month_status(s.run_registry(spark, sf_dir), F.lit(s.NOW).cast("timestamp"))


def _stored_pages(spark, sf_dir) -> DataFrame:
    """Every other host is registered already, as its first page shows it."""
    rows = s.page_registry(spark, sf_dir)
    stored = ordered.keep_first(rows, ["staff_directory"], "ord").where("ord % 2 = 0")
    extra = {
        "successful_rule": F.lit(None).cast("string"), "rule_failed_last_time": F.lit(False), "last_processed_at": F.lit(None).cast("timestamp"),
        "process_count": F.lit(0).cast("bigint"), "last_staff_count": F.lit(0).cast("bigint"),
    }
    return stored.withColumns(extra).drop("url", "ord")


@query
def registry_merge_plan(spark, sf_dir):
    incoming = s.page_registry(spark, sf_dir).withColumn("base_url", F.when(F.col("ord") % 17 != 0, F.col("base_url")))
    plan = registry.merge_plan(_stored_pages(spark, sf_dir), incoming)
    return plan.select("ord", "staff_directory", "action", listed("changed"))


@query
def registry_merge(spark, sf_dir):
    merged = registry.merge_registry(_stored_pages(spark, sf_dir), s.page_registry(spark, sf_dir))
    return merged.select("staff_directory", "base_url", "ipeds", "school_name", "is_active")


@query
def registry_merge_counts(spark, sf_dir):
    incoming = s.page_registry(spark, sf_dir).withColumn("base_url", F.when(F.col("ord") % 17 != 0, F.col("base_url")))
    return registry.merge_counts(registry.merge_plan(_stored_pages(spark, sf_dir), incoming))


@query
def registry_insert(spark, sf_dir):
    rows = registry.import_new(_stored_pages(spark, sf_dir), s.page_registry(spark, sf_dir))
    return rows.select("staff_directory", "base_url", "is_active")


@query
def registry_dedupe(spark, sf_dir):
    return registry.dedupe_registry(s.page_registry(spark, sf_dir)).select("ord", "staff_directory", "base_url", "ipeds")


@query
def registry_duplicates(spark, sf_dir):
    return registry.duplicate_keys(s.page_registry(spark, sf_dir), "staff_directory")


@query
def registry_coverage(spark, sf_dir):
    return registry.coverage(s.page_registry(spark, sf_dir))


@query
def registry_of_sites(spark, sf_dir):
    """Registered hosts that belong to a site by base URL or by staff page."""
    rows = s.page_registry(spark, sf_dir)
    sites = rows.where("ord % 5 = 0").select("base_url", F.concat("base_url", F.lit("/staff")).alias("staff_directory"))
    stored = ordered.keep_first(rows, ["staff_directory"], "ord")
    return registry.registry_of_sites(stored, sites.distinct()).select("staff_directory", "base_url", "ord")


@query
def successful_urls(spark, sf_dir):
    return registry.successful_urls(s.registry(spark, sf_dir))


@query
def run_status(spark, sf_dir):
    rows = registry.apply_runs(s.run_registry(spark, sf_dir).drop("user_id"), s.runs(spark, sf_dir))
    return rows.select("staff_directory", "successful_rule", "rule_failed_last_time", second("last_processed_at"), "process_count", "last_staff_count")


@query
def run_outcomes(spark, sf_dir):
    return registry.outcome_counts(s.runs(spark, sf_dir))


# Upkeep


@query
def failure_queue(spark, sf_dir):
    runs = s.runs(spark, sf_dir)
    outcomes = runs.select(
        "staff_directory", "base_url", F.col("processed_at").alias("at"), "success", "failure_type",
        F.concat(F.lit("run "), "event_id").alias("error_message"), F.lit("<html>").alias("html"),
    )
    first, second_half = outcomes.where("at < timestamp'2024-01-15'"), outcomes.where("at >= timestamp'2024-01-15'")
    none = spark.createDataFrame([], "staff_directory string, base_url string, failure_type string, error_message string, html_excerpt string, last_attempt timestamp, attempt_count bigint")
    queue = upkeep.update_failures(upkeep.update_failures(none, first), second_half)
    return upkeep.list_failures(queue).select("staff_directory", "failure_type", "error_message", second("last_attempt"), "attempt_count", "html_snippet")


@query
def challenge_tracking(spark, sf_dir):
    runs = s.runs(spark, sf_dir)
    seen = runs.select("staff_directory", "base_url", F.col("processed_at").alias("at"), F.col("used_rule").alias("method"))
    none = spark.createDataFrame([], "staff_directory string, base_url string, first_detected timestamp, last_detected timestamp, detection_count bigint, always_protected boolean, last_success_with string")
    known = upkeep.update_challenge_sites(none, seen.where("at < timestamp'2024-01-15'"))
    rows = upkeep.update_challenge_sites(known, seen.where("at >= timestamp'2024-01-15'"))
    return rows.select("staff_directory", second("first_detected"), second("last_detected"), "detection_count", "last_success_with")


@query
def rollback_month(spark, sf_dir):
    """Everything of the last local month goes; sites point at their latest remaining order date."""
    log = s.change_log(spark, sf_dir)
    members = log.select("site_id", F.col("created_at").alias("snapshot_date"))
    first_seen = log.groupBy("site_id").agg(F.min("created_at").alias("first_seen_at"))
    sites = s.sites(spark, sf_dir).withColumn("latest_snapshot_id", F.lit("old"))
    tables = {"members": members, "change_log": log, "profiles": first_seen, "directories": s.registry(spark, sf_dir), "sites": sites}
    after = upkeep.rollback_month(tables, 2001, 8, dt.datetime(2001, 7, 1, 12))
    left = after["change_log"].groupBy("site_id").agg(F.count("*").alias("logs"))
    return after["sites"].join(left, "site_id", "left").select("site_id", "latest_snapshot_id", day("last_scraped_at"), F.coalesce("logs", F.lit(0)).alias("logs"))


@query
def category_backfill(spark, sf_dir):
    """Profiles of users get the categories of the latest snapshot of their site."""
    members = s.members(spark, sf_dir)
    profiles = identity.profiles_from(members).withColumn("categories", F.array(F.lit("none")))
    rows = identity.backfill_categories(profiles, members, snapshots.latest_dates(snapshots.snapshot_dates(members)))
    return rows.select("site_id", "fingerprint", listed("categories"))


@query
def site_reset(spark, sf_dir):
    """Two sites are reset: what remains of profiles and logs per site, and the registry's rules."""
    reset = s.sites(spark, sf_dir).where("site_id in ('3', '7')")
    tables = {"profiles": s.profiles(spark, sf_dir), "change_log": s.change_log(spark, sf_dir), "directories": s.registry(spark, sf_dir), "sites": s.sites(spark, sf_dir)}
    after = upkeep.reset_sites(tables, reset)
    counts = [after[t].groupBy("site_id").agg(F.count("*").alias(t)) for t in ("profiles", "change_log")]
    rows = after["sites"].join(counts[0], "site_id", "left").join(counts[1], "site_id", "left").join(after["directories"].drop("base_url"), "staff_directory")
    return rows.select("site_id", F.coalesce("profiles", F.lit(0)).alias("profiles"), F.coalesce("change_log", F.lit(0)).alias("change_log"), "successful_rule", "rule_failed_last_time")


# URLs, texts, pages


@query
def url_protocol(spark, sf_dir):
    """URLs without their scheme, scheme-relative, padded or as they are."""
    key, url = F.col("page_id"), F.col("url")
    bare = F.regexp_replace("url", "^https?:", "")
    damaged = F.when(key % 4 == 0, F.regexp_replace("url", "^https?://", "")).when(key % 4 == 1, bare).when(key % 4 == 2, F.concat(F.lit("  "), url)).otherwise(url)
    return s.table(spark, sf_dir, "pages").select("page_id", urls.ensure_protocol(damaged).alias("url"))


@query
def url_repair(spark, sf_dir):
    """Every third staff page was glued to its base URL."""
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    page = F.when(F.col("page_id") % 3 == 0, F.concat(base, F.lit("/www.other"), F.col("page_id"), F.lit(".test/staff"))).otherwise(F.col("url"))
    rows = s.table(spark, sf_dir, "pages").select("page_id", base.alias("base_url"), page.alias("staff_directory"))
    return registry.fix_doubled_urls(rows)


@query
def school_from_host(spark, sf_dir):
    bare = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    rows = s.table(spark, sf_dir, "pages").select("page_id", bare.alias("u"))
    school = names.school_from_url(F.col("u"))
    return rows.select("page_id", school.alias("school"), names.slug(school).alias("slug"))


@query
def contact_extract(spark, sf_dir):
    """First email and phone of every document, over its whole text, with the phone in three formats."""
    t = F.col("text")
    phone = contacts.find_phone(t)
    rows = s.table(spark, sf_dir, "documents").select("doc_id", contacts.find_email(t).alias("email"), phone.alias("phone"))
    return rows.where("email is not null or phone is not null").select(
        "doc_id", "email", "phone", contacts.dashed_phone(F.col("phone")).alias("dashed"), contacts.bracketed_phone(F.col("phone")).alias("bracketed")
    )


@query
def heading_carry(spark, sf_dir):
    """The user's last message stands over the turns that follow it, in conversations of any length."""
    rows = s.table(spark, sf_dir, "conversations")
    heading = F.when(F.col("role") == "user", F.md5("text"))
    return ordered.carry_last(rows, ["conv_id"], "turn", heading, "heading").select("conv_id", "turn", "role", "heading")


@query
def page_element_counts(spark, sf_dir):
    return page_elements(s.table(spark, sf_dir, "pages")).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


NAV_RULE = extraction.Rule(
    "nav_links", extraction.Find(tag="li", inside="nav"),
    {"name": [extraction.Find(tag="a")], "profile_url": [extraction.Find(tag="a", attr="href", take="link")]},
    page_heading=extraction.Find(tag="h1"), key=("name", "profile_url"),
)


@query
def page_links(spark, sf_dir):
    pages = s.table(spark, sf_dir, "pages")
    return extraction.run_rules(pages, [NAV_RULE]).select("page_id", "name", "profile_url")


TH_RULE = extraction.Rule(
    "th_links", extraction.Find(tag="li", inside="nav"),
    {"name": [extraction.Find(tag="a", attr="href", prefix="/th")], "profile_url": [extraction.Find(tag="a", attr="href", take="link")]},
    key=("name", "profile_url"),
)


@query
def rule_cascade(spark, sf_dir):
    """Winning rule and number of people per page: tables, some links, all links; every other page remembers all links."""
    pages = s.table(spark, sf_dir, "pages")
    known = pages.where("page_id % 2 = 0").select("page_id", F.lit("nav_links").alias("known_rule"))
    people = extraction.extract_people(pages, [extraction.GENERIC_TABLE, TH_RULE, NAV_RULE], known)
    return extraction.page_outcomes(pages, people).select("page_id", "used_rule", "staff_count", "outcome")


@query
def rule_outcomes(spark, sf_dir):
    """Pages by outcome when only links below ``/th`` count, as they become failures of the queue."""
    pages = s.table(spark, sf_dir, "pages")
    outcomes = extraction.page_outcomes(pages, extraction.extract_people(pages, [TH_RULE]))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("pages"), F.sum("staff_count").alias("people"))


@query
def challenge_pages(spark, sf_dir):
    rows = s.table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return rows.select("doc_id", contacts.is_challenge_page(F.concat(F.col("text"), F.when(F.col("doc_id") % 9 == 0, "<b>Just a moment").otherwise(""))).alias("blocked"))


@query
def email_duplicates(spark, sf_dir):
    """Keep-first by email over all documents: the first document that shows an address."""
    rows = s.table(spark, sf_dir, "documents").select("doc_id", contacts.find_email(F.col("text")).alias("email")).where("email is not null")
    return ordered.keep_first(rows, ["email"], "doc_id")


@query
def ordered_rank(spark, sf_dir):
    """Position of every order in its status group: three groups hold the whole table."""
    rows = s.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    return ordered.grouped_rank(rows, ["o_orderstatus"], "o_orderkey", out="place")


def _collected(spark, sf_dir, rule):
    """A run over the given pages of sites that are not known yet."""
    none = [schemas.empty(spark, x) for x in (schemas.DIRECTORIES, schemas.SITES, schemas.PROFILES)]
    return ingest(s.table(spark, sf_dir, "pages"), *none, dt.datetime(2024, 5, 1, 12), [rule])


@query
def ingest_members(spark, sf_dir):
    """People that a run stores, with the identities of their sites."""
    return _collected(spark, sf_dir, NAV_RULE).members.select("site_id", "name", "profile_url", "fingerprint")


@query
def ingest_snapshots(spark, sf_dir):
    return _collected(spark, sf_dir, NAV_RULE).snapshots.select("site_id", "snapshot_id", "hash", "total_count")


@query
def ingest_sites(spark, sf_dir):
    return _collected(spark, sf_dir, NAV_RULE).sites.select("site_id", "base_url", "staff_directory", "latest_snapshot_id")


@query
def ingest_runs(spark, sf_dir):
    return _collected(spark, sf_dir, TH_RULE).runs.select("staff_directory", "base_url", "success", "used_rule", "staff_count", "failure_type")


@query
def ingest_failures(spark, sf_dir):
    """Failed pages as the queue gets them, with the digest of the kept beginning."""
    rows = _collected(spark, sf_dir, TH_RULE).outcomes.where("not success")
    return rows.select("staff_directory", "failure_type", "error_message", F.md5("html").alias("excerpt"))


def _renewed_members(spark, sf_dir):
    """Two snapshots of every nation's customers: some only in one of them, some with another title in the second."""
    key = F.col("c_custkey")
    name = F.translate(F.substring(F.md5(F.concat(F.lit("n"), key)), 1, 12), "0123456789", "ghijklmnop")
    both = s.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("site_id"), key.alias("ord"), F.md5(key.cast("string")).alias("fingerprint"), name.alias("name"),
        F.array(F.concat(F.lit("c"), key, F.lit("@site.test"))).alias("emails"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("later"),
    ).where("later = 0 and ord % 5 <> 0 or later = 1 and ord % 7 <> 0")
    key = F.col("ord")
    title = F.concat(F.lit("T"), key % 3 + F.when((F.col("later") == 1) & (key % 11 == 0), 1).otherwise(0))
    dated = both.withColumn("title", title).withColumn("snapshot_date", F.when(F.col("later") == 0, F.lit("2024-01-01")).otherwise("2024-02-01").cast("timestamp"))
    return s._as_members(dated.withColumn("category", F.lit("default")).drop("later"))


def _log_rows(log):
    return log.select("site_id", day("from_date"), day("to_date"), "added_count", "removed_count", "updated_count")


@query
def reprocess_full(spark, sf_dir):
    return _log_rows(changes.reprocess(_renewed_members(spark, sf_dir))[0])


@query
def reprocess_site(spark, sf_dir):
    return _log_rows(changes.reprocess(_renewed_members(spark, sf_dir), mode="site", site_id="7")[0])


@query
def reprocess_resume(spark, sf_dir):
    """Only the sites without a log: those of the first region have one."""
    done = s.table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").cast("string").alias("site_id"))
    return _log_rows(changes.reprocess(_renewed_members(spark, sf_dir), done, mode="resume")[0])


@query
def reprocess_entries(spark, sf_dir):
    """Every entry of the rebuilt logs."""
    return changes.reprocess(_renewed_members(spark, sf_dir))[1].select("site_id", "kind", "name")


# Column functions and row shapes


@query
def contact_links(spark, sf_dir):
    """Contact links, phones with a country code, and extensions, written from customer rows."""
    key = F.col("c_custkey")
    phone = F.concat(F.lit("555"), F.lpad(key.cast("string"), 7, "0"))
    rows = s.table(spark, sf_dir, "customer").select(
        key, contacts.mailto_address(F.concat(F.when(key % 2 == 0, "MAILTO:").otherwise("mailto:"), key, F.lit("@x.test?subject=a"))).alias("mail"),
        contacts.tel_number(F.concat(F.lit("tel:"), phone)).alias("tel"),
        contacts.plus_dashed_phone(F.concat(F.when(key % 2 == 0, "+1").otherwise(""), phone)).alias("plus"),
        contacts.with_extension(phone, F.when(key % 3 == 0, F.concat(F.lit("call Ext. "), key))).alias("extended"),
    )
    return rows


@query
def script_emails(spark, sf_dir):
    key = F.col("c_custkey")
    one = F.concat(F.lit("var full_email = 'c"), key, F.lit("@x.test'"))
    two = F.concat(F.lit('var firstHalf = "c'), key, F.lit('"; var secondHalf = "y.test"'))
    script = F.when(key % 3 == 0, one).when(key % 3 == 1, two).otherwise("var other = 1")
    return s.table(spark, sf_dir, "customer").select("c_custkey", contacts.script_email(script).alias("email"))


@query
def inline_text(spark, sf_dir):
    """Tags to text, honorifics off, over all part names."""
    html = F.concat(F.lit("<b>Dr. "), F.col("p_name"), F.lit("</b><BR/>R&amp;D&nbsp;"))
    return s.table(spark, sf_dir, "part").select("p_partkey", text.strip_tags(html).alias("plain"), names.strip_honorific(F.concat(F.lit("dr. "), F.col("p_name"))).alias("bare"))


@query
def same_structures(spark, sf_dir):
    left, right = F.struct("l_returnflag", F.array("l_linenumber")), F.struct("l_linestatus", F.array("l_linenumber"))
    same = text.same_structure(left, F.struct(F.col("l_returnflag"), F.array("l_linenumber")))
    return s.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(same).alias("same"), F.count_if(text.same_structure(left, right)).alias("crossed"))


@query
def stateless_fingerprints(spark, sf_dir):
    email = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit(" C"), F.col("c_custkey"), F.lit("@X.test")))
    return s.table(spark, sf_dir, "customer").select("c_custkey", identity.stateless_fingerprint(email, F.col("c_name")).alias("fingerprint"))


@query
def change_array_totals(spark, sf_dir):
    """Totals over change documents with entry arrays: one per order, kinds by return flag."""
    kind = {"added": "N", "removed": "R", "updated": "A"}
    entries = [F.collect_list(F.when(F.col("l_returnflag") == flag, F.col("l_linenumber"))).alias(name) for name, flag in kind.items()]
    docs = s.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*entries)
    return dashboard.array_totals(docs.withColumn("removed", F.when(F.size("removed") > 0, F.col("removed"))))


@query
def parallel_lists(spark, sf_dir):
    """Lists of one order back to rows; a short list leaves gaps."""
    lists = s.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("numbers"))
    rows = lists.withColumn("names", F.transform("numbers", lambda n: F.concat(F.lit("n"), n))).withColumn("titles", F.transform(F.filter("numbers", lambda n: n <= 2), lambda n: F.concat(F.lit("t"), n)))
    return nesting.zip_parallel(rows, ["l_orderkey"], "names", title="titles").select("l_orderkey", F.col("place").cast("bigint").alias("place"), "name", "title")


@query
def social_links(spark, sf_dir):
    """Open objects of links: empty ones are dropped, the last of a platform wins."""
    key = F.col("s_suppkey")
    link = lambda platform, url: F.struct(F.lit(platform).alias("platform"), url.alias("link"))
    links = F.array(link("x", F.concat(F.lit("old/"), key)), link("y", F.when(key % 2 == 0, F.concat(F.lit(" y/"), key)).otherwise("")), link("x", F.when(key % 3 == 0, F.concat(F.lit("new/"), key))))
    made = nesting.link_map(links)
    return s.table(spark, sf_dir, "supplier").select("s_suppkey", made["x"].alias("x"), made["y"].alias("y"), F.size(made).cast("bigint").alias("n"))


@query
def written_exports(spark, sf_dir):
    """The schools' export written as CSV, JSON and Parquet and read back: rows of each file type."""
    rows = export_school(spark, sf_dir)
    root = f"{app_folder(spark)}/exports-{uuid.uuid4().hex}"
    back = []
    for fmt in ("csv", "json", "parquet"):
        export.write_export(rows, f"{root}/{fmt}", fmt)
        read = spark.read.schema(rows.schema).option("header", fmt == "csv").option("escape", "\"").option("nullValue", "\u0001").format(fmt).load(f"{root}/{fmt}")
        back.append(read.withColumn("file_type", F.lit(fmt)))
    return back[0].unionByName(back[1]).unionByName(back[2])


@query
def latest_export(spark, sf_dir):
    """The newest active file of one type, of one written for every order."""
    key = F.col("o_orderkey")
    manifest = s.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("changes-"), key).alias("filename"), F.when(key % 2 == 0, "changes").otherwise("full").alias("file_type"),
        F.col("o_orderdate").cast("timestamp").alias("generated_at"), (key % 3 != 0).alias("is_active"),
    )
    return export.latest_active(manifest, "changes").select("filename", day("generated_at"))


def _streamed(spark, sf_dir, name: Column | None = None):
    """The intake after events have streamed in as sightings, a snapshot per ten days."""
    root = f"{app_folder(spark)}/intake-{uuid.uuid4().hex}"
    user = F.col("user_id")
    rows = spark.readStream.schema(s.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet").select(
        (user % 10).cast("string").alias("site_id"),
        F.expr("timestampadd(DAY, 10 * least(int((day(ts) - 1) / 10), 2), date_trunc('month', cast(ts as timestamp)))").alias("snapshot_date"),
        F.col("event_id").alias("ord"), (F.concat(F.lit("User "), user) if name is None else name).alias("name"), F.col("event_type").alias("title"),
        F.when(user % 3 != 0, F.concat(F.lit("user"), user, F.lit("@site.test"))).alias("email"), F.lit(None).cast("string").alias("phone"),
        F.col("event_type").alias("category"), F.lit(None).cast("string").alias("profile_url"),
    )
    intake = Intake(spark, root)
    stream = rows.writeStream.foreachBatch(intake.take).option("checkpointLocation", f"{root}/_stream").trigger(availableNow=True).start()
    stream.awaitTermination()
    return intake


@query
def stream_intake(spark, sf_dir):
    """The profiles that the intake leaves."""
    return _streamed(spark, sf_dir).profiles().select("site_id", "fingerprint", "canonical_name", day("first_seen_at"), day("last_seen_at"), listed("categories"))


@query
def stream_members(spark, sf_dir):
    """The members of the two snapshots of every site that the intake keeps."""
    return _streamed(spark, sf_dir).members().select("site_id", day("snapshot_date"), "ord", "fingerprint", "title")


@query
def stream_log(spark, sf_dir):
    """The change logs that the intake leaves. Names are digests, so only equal names are similar."""
    log = _streamed(spark, sf_dir, F.md5(F.col("user_id").cast("string"))).change_log()
    return log.select("site_id", day("from_date"), day("to_date"), "added_count", "removed_count", "updated_count")


# Layouts and users' rules


@query
def page_layouts(spark, sf_dir):
    """People of pages of eight layouts, by the cascade; the last layout stands only in the rendered page."""
    grouped = extraction.grouped_table_rule("grouped", "staff", extraction.Find(tag="tr", cls="head"), ["name", "title", "email"])
    late = extraction.Rule(
        "late", extraction.Find(tag="tr", inside=".late"),
        {"name": [extraction.Find(tag="td", cell=0)], "title": [extraction.Find(tag="td", cell=1)], "email": [extraction.Find(tag="a", attr="href", prefix="mailto:", take="mailto")]},
        page_heading=extraction.Find(tag="h1", cls="unit"), category="Staff",
    )
    rules = [extraction.MICRODATA, extraction.DATA_ROWS, grouped, late, extraction.Rule("headed", extraction.Find(tag="tr", inside="table"), extraction.SECTION_TABLES.fields, heading=extraction.Find(tag="h2|h3|caption"), key=("name", "title", "email", "category"), need_contact=True)]
    pages = s.layout_pages(spark, sf_dir)
    headed = pages.where(F.col("page_id") % 8 == 0)
    people = extraction.extract_people(headed, [rules[4]]).unionByName(
        extraction.extract_people(pages.where(F.col("page_id") % 8 != 0), [*rules[:4], table_roles.TableRoles(), extraction.FREE_TEXT])
    )
    return people.select("page_id", "rule", "name", "title", "email", "phone", "category", "profile_url")


def heading_lines(html: str, url: str) -> list[dict] | None:
    """A user's rule: every heading of a page is a person of the page's host."""
    host = url.split("/")[2] if url.count("/") > 1 else ""
    return [{"name": h.strip(), "title": "Heading", "category": host} for h in re.findall(r"<h1>([^<]*)</h1>", html)] or None


@query
def user_rule(spark, sf_dir):
    """A Python rule registered by name, over all pages."""
    extraction.register_rule(extraction.PythonRule("heading_lines", heading_lines))
    try:
        rules = [extraction.RULES["heading_lines"]]
        people = extraction.extract_people(s.table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules)
    finally:
        del extraction.RULES["heading_lines"]
    return people.select("page_id", F.col("ord").cast("bigint").alias("ord"), "rule", "name", "title", "category")


def heading_facts(html: str, url: str) -> list[dict]:
    """The headings again, with a field that no schema knows."""
    return [{**person, "letters": len(person["name"])} for person in heading_lines(html, url) or []]


@query
def sql_rule(spark, sf_dir):
    """A rule called from SQL as a table function, with its extra field."""
    sql_rules.register_table_rule(spark, extraction.PythonRule("heading_facts", heading_facts))
    return spark.sql(
        """SELECT page_id, CAST(ord AS BIGINT) AS ord, rule, name, category AS host, CAST(extras['letters'] AS BIGINT) AS letters,
                  COUNT(*) OVER (PARTITION BY page_id) AS on_page
           FROM heading_facts(TABLE(SELECT * FROM {pages}), extras => true)""",
        pages=s.table(spark, sf_dir, "pages"),
    )


@query
def registry_files(spark, sf_dir):
    """Registry rows from JSON arrays, several files, and from a six-column sheet, in one table."""
    key, root = F.col("c_custkey"), f"{app_folder(spark)}/registry-{uuid.uuid4().hex}"
    host = F.concat(F.lit("https://www.c"), key, F.lit(".test"))
    rows = s.table(spark, sf_dir, "customer").select(
        key.alias("k"), host.alias("baseUrl"), F.concat(host, F.lit("/staff")).alias("staffDirectory"), F.when(key % 3 == 0, key.cast("string")).alias("ipeds"),
        F.when(key % 5 == 0, " ").otherwise(F.concat(F.lit("School "), key)).alias("schoolName"), F.lit("golf").alias("sportsCode"),
    )
    objects = F.to_json(F.struct("baseUrl", "staffDirectory", "ipeds", "schoolName"))
    files = rows.where("k % 2 = 0").groupBy((F.col("k") / 2 % 4).cast("int").alias("part"))
    files.agg(F.concat(F.lit("["), F.array_join(F.collect_list(objects), ",\n"), F.lit("]")).alias("value")).write.partitionBy("part").text(f"{root}/json")
    sheet = rows.where("k % 2 = 1").select("ipeds", "schoolName", F.lit("").alias("athletics"), F.col("baseUrl").alias("college"), "sportsCode", "staffDirectory")
    sheet.write.option("header", True).csv(f"{root}/sheet")
    both = registry.read_registry_json(spark, f"{root}/json/*").unionByName(registry.read_registry_sheet(spark, f"{root}/sheet"), allowMissingColumns=True)
    return both.select("base_url", "staff_directory", "ipeds", "school_name", "sports_code")


@query
def unnested_members(spark, sf_dir):
    """Nested snapshot documents, one a day and site, unwound to members."""
    sections = nesting.nest(s.members(spark, sf_dir)).withColumn("c", F.struct(F.col("category").alias("name"), "count", "members"))
    placed = F.array_sort(F.collect_list(F.struct("cat_ord", "section", "c")), lambda a, b: F.signum((a["cat_ord"] - b["cat_ord"]) * 1000 + a["section"] - b["section"]).cast("int"))
    documents = sections.groupBy(*nesting.SNAPSHOT).agg(F.transform(placed, lambda x: x["c"]).alias("categories"))
    return nesting.unnest(documents).select("site_id", day(), "ord", "fingerprint", "title", "category")


@query
def export_changes_range(spark, sf_dir):
    """The changes of one site in a range of time."""
    rows = export.export_changes(
        s.entries(spark, sf_dir), s.change_log(spark, sf_dir), s.sites(spark, sf_dir), s.registry(spark, sf_dir),
        from_ts=dt.datetime(1995, 3, 1), to_ts=dt.datetime(1997, 6, 30), site_id="7",
    )
    return rows.select("change_type", day("change_date"), "unique_id", "email", "phone", "change_details")


@query
def school_changes(spark, sf_dir):
    """One school's changes, written as JSON and read back."""
    rows = export.school_changes(s.entries(spark, sf_dir), s.change_log(spark, sf_dir), s.sites(spark, sf_dir), s.registry(spark, sf_dir), school="school 1")
    path = f"{app_folder(spark)}/school-{uuid.uuid4().hex}"
    export.write_export(rows, path, "json")
    back = spark.read.schema(rows.schema).json(path)
    return back.select("change_type", day("change_date"), "school", "unique_id", "first_name", "last_name", "position", "email", "change_details")


# Large results


@query
def search_deep_page(spark, sf_dir):
    """The page in the middle of all people, five a page, from its own ranges."""
    people = search.people_of(search.sightings(s.members(spark, sf_dir), s.sites(spark, sf_dir), category="i", category_scope="member"))
    result = paging.paged(people.select("fingerprint", "name", "latest_seen"), [F.desc("latest_seen"), F.col("fingerprint")], limit=5, ranges=16)
    return result.page(result.pages // 2).select("position", "fingerprint", "name", day("latest_seen"))


@query
def suggestions_many(spark, sf_dir):
    """Ten most frequent values among very many: parts of order lines whose number holds a 7."""
    part = F.col("l_partkey").cast("string")
    values = s.table(spark, sf_dir, "lineitem").where(F.contains(part, F.lit("7"))).select(F.concat(F.lit("Part "), part).alias("value"))
    return topk.top_values(values, 10)
