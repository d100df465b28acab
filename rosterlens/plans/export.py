"""Flat exports of profiles and changes, their summaries, their audit and their manifest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens.functions.names import (
    change_position, first_name, full_export_position, last_name, school_export_position, school_from_url, slug,
)
from rosterlens.functions.text import blank_to_null, first_of, show_list
from rosterlens.operators.identity import primary
from rosterlens.operators.registry import by_base_url
from rosterlens.operators.skew import detach

# Change codes of updated fields, and the code where none applies.
FIELD_CODES = {"name": "j", "title": "j", "emails": "e", "phones": "#", "categories": "a"}
DEFAULT_CODE = "a"
LIST_FIELDS = ["emails", "phones", "categories"]
EXPORT_LIFE_DAYS = 7
PROFILE_COLUMNS = [
    "ipeds", "school", "unique_id", "sport_code", "first_name", "last_name", "position", "email", "phone", "last_updated",
]


def school_info(sites: DataFrame, registry: DataFrame) -> DataFrame:
    """Site -> institution id and school name; the host gives the name where the registry has none."""
    joined = sites.select("site_id", "base_url").join(by_base_url(registry), "base_url", "left")
    school = F.coalesce(blank_to_null(F.col("school_name")), school_from_url(F.col("base_url")))
    return joined.select("site_id", "base_url", F.coalesce("ipeds", F.lit("")).alias("ipeds"), school.alias("school"))


def _profile_rows(profiles: DataFrame, schools: DataFrame, position: Column) -> DataFrame:
    return profiles.join(schools, "site_id").select(
        "site_id", "ipeds", "school", F.coalesce("fingerprint", F.lit("")).alias("unique_id"),
        show_list(F.col("categories")).alias("sport_code"), first_name(F.col("canonical_name")).alias("first_name"),
        last_name(F.col("canonical_name")).alias("last_name"), position.alias("position"), primary("emails").alias("email"),
        primary("phones").alias("phone"), F.col("last_seen_at").alias("last_updated"),
    )


def export_profiles(profiles: DataFrame, sites: DataFrame, registry: DataFrame) -> DataFrame:
    """Every profile of every site, ten columns."""
    position = full_export_position(F.col("raw")["title"], F.col("title"))
    return _profile_rows(profiles, school_info(sites, registry), position).select(*PROFILE_COLUMNS)


def export_schools(profiles: DataFrame, sites: DataFrame, registry: DataFrame, site_id: str | None = None) -> DataFrame:
    """Per-school export, of one site or of all; ``school_slug`` is the partition to write by."""
    mine = profiles if site_id is None else profiles.where(F.col("site_id") == site_id)
    position = school_export_position(F.col("raw")["title"], F.col("title"), F.col("canonical_name"))
    rows = _profile_rows(mine, school_info(sites, registry), position)
    return rows.select(*PROFILE_COLUMNS, slug(F.col("school")).alias("school_slug"))


def diff_fields() -> Column:
    return F.transform(F.coalesce("diffs", F.array().cast("array<struct<field:string,before:array<string>,after:array<string>>>")), lambda d: d["field"])


def change_code(kind: str = "kind") -> Column:
    """``n`` new, ``r`` removed, else the codes of the changed fields in order of first appearance."""
    codes = F.create_map(*[F.lit(x) for pair in FIELD_CODES.items() for x in pair])
    found = F.array_join(F.array_distinct(F.array_compact(F.transform(diff_fields(), lambda f: F.try_element_at(codes, f)))), "")
    return F.when(F.col(kind) == "added", "n").when(F.col(kind) == "removed", "r").otherwise(
        F.coalesce(blank_to_null(found), F.lit(DEFAULT_CODE))
    )


def diff_text(arrow: str = " → ") -> Column:
    """``field: before → after`` for each diff, joined by semicolons; ``N/A`` for a missing side."""
    return F.array_join(
        F.transform(
            "diffs",
            lambda d: F.concat(
                d["field"], F.lit(": "), F.coalesce(F.array_join(d["before"], ","), F.lit("N/A")), F.lit(arrow),
                F.coalesce(F.array_join(d["after"], ","), F.lit("N/A")),
            ),
        ),
        "; ",
    )


def change_details(suffix: str = " category", arrow: str = " → ", missing: str = "Details not available") -> Column:
    where = F.coalesce(blank_to_null(show_list(F.col("categories"))), F.lit("default"))
    return (
        F.when(F.col("kind") == "added", F.concat(F.lit("Added to "), where, F.lit(suffix)))
        .when(F.col("kind") == "removed", F.concat(F.lit("Removed from "), where, F.lit(suffix)))
        .otherwise(F.coalesce(blank_to_null(diff_text(arrow)), F.lit(missing)))
    )


def period(start: str = "from_date", end: str = "to_date", arrow: str = " → ") -> Column:
    day = "M/d/yyyy"
    both = F.col(start).isNotNull() & F.col(end).isNotNull()
    return F.when(both, F.concat(F.date_format(start, day), F.lit(arrow), F.date_format(end, day))).otherwise(F.lit("N/A"))


def entry_rows(entries: DataFrame, change_log: DataFrame, from_ts=None, to_ts=None, site_id: str | None = None) -> DataFrame:
    """Entries with their log's dates, optionally of a time range or one site."""
    logs = change_log.select("change_id", "site_id", "from_date", "to_date", "created_at")
    if from_ts is not None:
        logs = logs.where(F.col("created_at") >= F.lit(from_ts))
    if to_ts is not None:
        logs = logs.where(F.col("created_at") < F.lit(to_ts))
    if site_id is not None:
        logs = logs.where(F.col("site_id") == site_id)
    return entries.drop("site_id", "from_date", "to_date").join(logs, "change_id")


def contact(rows: DataFrame, field: str) -> Column:
    """``email`` or ``phone`` of an entry: the first listed one, else the open ``raw`` object's single value, else the first of its list.

    ``raw`` is a VARIANT, or a map of texts in which a list stands as JSON; a missing column or value
    is passed over. Empty text when nothing is left.
    """
    listed, raw = f"{field}s", F.col("raw")
    found = [first_of(F.col(listed))]
    kind = rows.schema["raw"].dataType if "raw" in rows.columns else None
    if isinstance(kind, T.VariantType):
        found += [F.try_variant_get(raw, path, "string") for path in (f"$.{field}", f"$.{listed}[0]")]
    elif isinstance(kind, T.MapType):
        found += [F.try_element_at(raw, F.lit(field)), first_of(F.from_json(F.try_element_at(raw, F.lit(listed)), "array<string>"))]
    return F.coalesce(found[0], *[blank_to_null(c) for c in found[1:]], F.lit(""))


def export_changes(
    entries: DataFrame, change_log: DataFrame, sites: DataFrame, registry: DataFrame, from_ts=None, to_ts=None,
    site_id: str | None = None,
) -> DataFrame:
    """Every change entry as a row of fourteen columns; logs of unknown sites are left out."""
    rows = entry_rows(entries, change_log, from_ts, to_ts, site_id).join(school_info(sites, registry), "site_id")
    coded = rows.withColumn("change_type", change_code()).withColumn("full_name", F.coalesce("name", F.lit("")))
    return coded.select(
        "change_type", F.col("created_at").alias("change_date"), "ipeds", "school",
        F.coalesce("fingerprint", F.lit("")).alias("unique_id"), show_list(F.col("categories")).alias("sport_code"),
        first_name(F.col("full_name")).alias("first_name"), last_name(F.col("full_name")).alias("last_name"),
        change_position(F.col("title"), F.col("full_name"), F.when(F.col("kind") == "updated", F.col("change_type"))).alias("position"),
        contact(coded, "email").alias("email"), contact(coded, "phone").alias("phone"), change_details().alias("change_details"),
        period().alias("snapshot_period"), "full_name",
    )


def export_recent_changes(entries: DataFrame, change_log: DataFrame, sites: DataFrame, registry: DataFrame) -> DataFrame:
    """Reduced form: thirteen columns, plain titles and contacts, school from the host only."""
    rows = entry_rows(entries, change_log).join(
        school_info(sites, registry).withColumn("school", school_from_url(F.col("base_url"))), "site_id"
    )
    return rows.select(
        change_code().alias("change_type"), F.col("created_at").alias("change_date"), "ipeds", "school",
        F.coalesce("fingerprint", F.lit("")).alias("unique_id"), show_list(F.col("categories")).alias("sport_code"),
        first_name(F.col("name")).alias("first_name"), last_name(F.col("name")).alias("last_name"),
        F.coalesce("title", F.lit("")).alias("position"), primary("emails").alias("email"), primary("phones").alias("phone"),
        change_details(suffix="", arrow=" -> ", missing="Updated").alias("change_details"),
        period(arrow=" -> ").alias("snapshot_period"),
    )


def export_summary(entries: DataFrame, change_log: DataFrame, sites: DataFrame) -> DataFrame:
    """Summary sheet of the changes export as (metric, value); zeros when there is nothing.

    The total counts the rows of the export, which leaves out logs of unknown sites.
    """
    exported = change_log.join(sites.select("site_id"), "site_id", "left_semi").select("change_id", F.lit(1).alias("exported"))
    kinds = entries.select("change_id", "kind").join(exported, "change_id", "left").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "updated")], F.count("exported").alias("total")
    )
    logs = change_log.agg(F.count("*").alias("logs"))
    both = kinds.unionByName(logs, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("logs", "added", "removed", "updated", "total")])
    labels = {
        "logs": "Total Change Records", "added": "Staff Added", "removed": "Staff Removed", "updated": "Staff Updated",
        "total": "Total Changed Staff",
    }
    pairs = F.array(*[F.struct(F.lit(label).alias("metric"), F.col(c).alias("value")) for c, label in labels.items()])
    return both.select(F.explode(pairs).alias("m")).select("m.*")


def school_changes(
    entries: DataFrame, change_log: DataFrame, sites: DataFrame, registry: DataFrame, school: str | None = None
) -> DataFrame:
    """Changes of the schools whose registered name contains ``school`` (all when None), with plain type codes."""
    named = registry.where("school_name <> ''")
    if school is not None:
        named = named.where(F.contains(F.lower("school_name"), F.lit(school.lower())))
        named = named.orderBy("staff_directory").limit(1)
    owners = named.select("base_url", "ipeds", F.col("school_name").alias("school")).dropDuplicates(["base_url"])
    located = sites.select("site_id", "base_url").join(owners, "base_url")
    full = F.coalesce(blank_to_null(F.col("name")), blank_to_null(F.col("title")), F.lit(""))
    rows = entry_rows(entries, change_log).join(located, "site_id").withColumn("full_name", full)
    code = F.when(F.col("kind") == "added", "n").when(F.col("kind") == "removed", "r").otherwise("j")
    details = (
        F.when(F.col("kind") == "added", "Added to category").when(F.col("kind") == "removed", "Removed from category")
        .otherwise(F.coalesce(blank_to_null(diff_text()), F.lit("Updated")))
    )
    spaced = F.col("full_name").contains(" ")
    return rows.select(
        code.alias("change_type"), F.col("created_at").alias("change_date"), "ipeds", "school",
        F.coalesce("fingerprint", F.lit("")).alias("unique_id"), show_list(F.col("categories")).alias("sport_code"),
        F.when(spaced, first_name(F.col("full_name"))).otherwise(F.col("full_name")).alias("first_name"),
        F.when(spaced, last_name(F.col("full_name"))).otherwise(F.lit("")).alias("last_name"), "full_name",
        F.coalesce("title", F.lit("")).alias("position"), primary("emails").alias("email"), primary("phones").alias("phone"),
        details.alias("change_details"), F.coalesce(F.concat(F.col("from_date").cast("string"), F.lit(" → "), F.col("to_date").cast("string")), F.lit("N/A")).alias("snapshot_period"),
    )


def change_quality(rows: DataFrame) -> DataFrame:
    """Per school: changes by type and how complete the names are."""
    code, first, last = F.col("change_type"), F.col("first_name") != "", F.col("last_name") != ""
    missing = F.trim("full_name") == ""
    counted = rows.groupBy("school", "ipeds").agg(
        F.count("*").alias("total_changes"), F.count_if(code == "n").alias("added"), F.count_if(code == "r").alias("removed"),
        F.count_if(code == "j").alias("updated"), F.count_if(missing).alias("missing_names"),
        F.count_if(first & last).alias("names_with_first_last"), F.count_if(first & ~last).alias("only_first_name"),
    )
    return counted.withColumn(
        "issues",
        F.when(F.col("missing_names") > 0, F.concat(F.col("missing_names").cast("string"), F.lit(" records missing full name"))).otherwise(""),
    )


def audit_export(exported: DataFrame, entries: DataFrame, change_log: DataFrame, members: DataFrame) -> DataFrame:
    """Exported rows (change_type, unique_id) checked against the newest log of the person and its two snapshots."""
    logs = change_log.select("change_id", "site_id", "from_date", "to_date", "created_at")
    touched = entries.select("change_id", "fingerprint").distinct().join(logs, "change_id")
    newest = touched.groupBy("fingerprint").agg(
        F.max_by(F.struct("site_id", "from_date", "to_date", "change_id"), F.struct("created_at", "change_id")).alias("log")
    )
    present = members.select("site_id", "snapshot_date", F.col("fingerprint").alias("unique_id")).distinct()
    rows = (
        exported.where((F.col("unique_id") != "") & (F.col("change_type") != ""))
        .join(detach(newest.withColumnRenamed("fingerprint", "unique_id")), "unique_id", "left")
        .withColumns({c: F.col(f"log.{c}") for c in ("change_id", "site_id", "from_date", "to_date")})
    )
    for side in ("from", "to"):
        there = present.withColumnRenamed("snapshot_date", f"{side}_date").withColumn(f"in_{side}", F.lit(True))
        rows = rows.join(there, ["site_id", f"{side}_date", "unique_id"], "left")
    rows = rows.withColumns({f"in_{s}": F.coalesce(f"in_{s}", F.lit(False)) for s in ("from", "to")})
    code = F.col("change_type")
    fits = (
        F.when(code == "n", ~F.col("in_from") & F.col("in_to"))
        .when(code == "r", F.col("in_from") & ~F.col("in_to"))
        .otherwise(F.col("in_from") & F.col("in_to"))
    )
    verdict = (
        F.when(F.col("change_id").isNull(), "no_log")
        .when(F.col("from_date").isNull() | F.col("to_date").isNull(), "no_snapshots")
        .when(fits, "verified")
        .otherwise("failed")
    )
    return rows.select("change_type", "unique_id", "change_id", "in_from", "in_to", verdict.alias("verdict"))


def register_export(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """Manifest after registering ``new`` exports (filename, file_type, site_id, record_count, generated_at).

    A known filename is not registered again. Of full and of changes exports only the newest
    registered one stays active; exports of single schools stay active side by side.
    """
    fresh = new.join(manifest.select("filename"), "filename", "left_anti").select(
        "filename", "file_type", "site_id", "record_count", "generated_at",
        (F.col("generated_at") + F.expr(f"INTERVAL {EXPORT_LIFE_DAYS} DAYS")).alias("expires_at"), F.lit(True).alias("is_active"),
    )
    newest = (
        fresh.where("file_type <> 'university'").groupBy("file_type")
        .agg(F.max_by("filename", F.struct("generated_at", "filename")).alias("_newest"))
    )
    both = manifest.select(*fresh.columns).unionByName(fresh).join(newest, "file_type", "left")
    keep = F.col("_newest").isNull() | (F.col("filename") == F.col("_newest"))
    return both.withColumn("is_active", F.col("is_active") & keep).select(*fresh.columns)


def latest_active(manifest: DataFrame, file_type: str) -> DataFrame:
    return manifest.where((F.col("file_type") == file_type) & F.col("is_active")).orderBy(F.desc("generated_at"), "filename").limit(1)


def expire_exports(manifest: DataFrame, now: dt.datetime | Column, days: int = EXPORT_LIFE_DAYS) -> DataFrame:
    """Exports older than ``days`` become inactive."""
    at = now if isinstance(now, Column) else F.lit(now)
    old = F.col("generated_at") < at - F.expr(f"INTERVAL {days} DAYS")
    return manifest.withColumn("is_active", F.col("is_active") & ~old)


def write_export(rows: DataFrame, path: str, fmt: str = "csv", by: list[str] | None = None) -> None:
    """Write an export in parallel; an empty one still has its header."""
    writer = rows.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)
