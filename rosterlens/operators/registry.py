"""The directory registry: sources, merging, deduplication, due lists, run results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.functions.text import full_trim, local_year_month
from rosterlens.functions.urls import ensure_protocol, repair_doubled
from rosterlens.operators.ordered import grouped_rank, keep_first
from rosterlens.operators.skew import detach
from rosterlens.schemas import REGISTRY_JSON

URL_COLUMNS = ["base_url", "staff_directory", "athletic_website", "college_website"]
MERGED_FIELDS = ["base_url", "ipeds", "school_name"]


def read_registry_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of registry objects, in one file or many."""
    raw = spark.read.schema(REGISTRY_JSON).option("multiLine", True).json(path)
    return raw.select(
        F.col("baseUrl").alias("base_url"), F.col("staffDirectory").alias("staff_directory"), "ipeds",
        F.col("schoolName").alias("school_name"), F.col("athleticWebsite").alias("athletic_website"),
        F.col("collegeWebsite").alias("college_website"), F.col("sportsCode").alias("sports_code"),
    )


def read_registry_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Six-column sheet saved as CSV: ipeds, school, athletic site, college site, sport code, staff page."""
    names = ["ipeds", "school_name", "athletic_website", "college_website", "sports_code", "staff_directory"]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", True).option(
        "enforceSchema", True
    ).csv(path)
    cleaned = rows.select(*[full_trim(F.coalesce(n, F.lit(""))).alias(n) for n in names])
    return cleaned.where("school_name <> ''").withColumn("base_url", F.col("college_website"))


def fix_protocols(registry: DataFrame) -> DataFrame:
    return registry.withColumns({c: ensure_protocol(F.col(c)) for c in URL_COLUMNS if c in registry.columns})


def fix_doubled_urls(registry: DataFrame) -> DataFrame:
    return registry.withColumn("staff_directory", repair_doubled(F.col("base_url"), F.col("staff_directory")))


def _first_per_directory(incoming: DataFrame, order: str) -> DataFrame:
    return keep_first(incoming.where("staff_directory <> ''"), ["staff_directory"], order)


def import_new(registry: DataFrame, incoming: DataFrame, order: str = "ord") -> DataFrame:
    """Incoming rows whose staff page is not registered yet, once each, as fresh active rows."""
    new = _first_per_directory(incoming, order).join(registry.select("staff_directory"), "staff_directory", "left_anti")
    return new.select(
        "base_url", "staff_directory", F.lit("").alias("ipeds"), F.lit("").alias("school_name"), F.lit(True).alias("is_active")
    )


def merge_plan(registry: DataFrame, incoming: DataFrame, order: str = "ord") -> DataFrame:
    """What a merge does with each incoming row: import, update (and which fields), skip.

    Rows of one staff page are applied in order; each is compared with the row before it,
    the first with the registry. Rows without required fields are skipped.
    """
    complete = (F.coalesce("base_url", F.lit("")) != "") & (F.coalesce("staff_directory", F.lit("")) != "")
    values = F.struct(
        F.col("base_url").alias("base_url"), F.coalesce("ipeds", F.lit("")).alias("ipeds"),
        F.coalesce("school_name", F.lit("")).alias("school_name"), F.lit(True).alias("is_active"),
    )
    rows = incoming.where(complete).select("staff_directory", F.col(order).alias("ord"), values.alias("new"))
    stored = registry.select(
        "staff_directory", F.lit(-1).cast("bigint").alias("ord"), F.struct(*MERGED_FIELDS, "is_active").alias("new")
    )
    # The row before: positions of one page, paired by rank, so that a page listed very often stays distributed.
    ranked = grouped_rank(rows.withColumn("ord", F.col("ord").cast("bigint")).unionByName(stored), ["staff_directory"], "ord")
    previous = ranked.select("staff_directory", (F.col("rank") + 1).alias("rank"), F.col("new").alias("old"))
    paired = ranked.where("ord >= 0").join(previous, ["staff_directory", "rank"], "left")
    changed = F.array_compact(
        F.array(*[F.when(~F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")), F.lit(c)) for c in [*MERGED_FIELDS, "is_active"]])
    )
    action = F.when(F.col("old").isNull(), "import").when(F.size("changed") > 0, "update").otherwise("skip")
    planned = paired.withColumn("changed", F.when(F.col("old").isNotNull(), changed)).select(
        "staff_directory", "ord", "new.*", "changed", action.alias("action")
    )
    skipped = incoming.where(~complete).select(
        "staff_directory", F.col(order).cast("bigint").alias("ord"), "base_url", F.lit("skip").alias("action")
    )
    return planned.unionByName(skipped, allowMissingColumns=True)


def merge_registry(registry: DataFrame, incoming: DataFrame, order: str = "ord") -> DataFrame:
    """The registry after the merge: the last complete incoming row of a page gives the merged fields."""
    plan = merge_plan(registry, incoming, order).where("base_url <> '' and staff_directory <> ''")
    last = plan.groupBy("staff_directory").agg(
        F.max_by(F.struct(*MERGED_FIELDS), F.col("ord")).alias("_new"), F.max((F.col("action") == "import").cast("int")).alias("_is_new")
    )
    kept = [c for c in registry.columns if c not in [*MERGED_FIELDS, "staff_directory", "is_active"]]
    merged = registry.join(last, "staff_directory", "full_outer")
    defaults = {"rule_failed_last_time": F.lit(False), "process_count": F.lit(0), "last_staff_count": F.lit(0)}
    return merged.select(
        "staff_directory",
        *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in MERGED_FIELDS],
        F.when(F.col("_new").isNotNull(), F.lit(True)).otherwise(F.col("is_active")).alias("is_active"),
        *[(F.coalesce(c, F.when(F.col("_is_new") == 1, defaults[c])) if c in defaults else F.col(c)).alias(c) for c in kept],
    ).select(*registry.columns)


def merge_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"))


def coverage(registry: DataFrame) -> DataFrame:
    """Registry size, with and without an institution id."""
    filled = F.coalesce("ipeds", F.lit("")) != ""
    return registry.agg(
        F.count("*").alias("total"), F.count_if(filled).alias("with_ipeds"), F.count_if(~filled).alias("without_ipeds")
    )


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dedupe_registry(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Best rows per staff page: the first with an institution id, plus later ones with another base URL.

    Without any institution id the first row stays. The kept row is found by an aggregate and
    compared by a join, so a page with very many rows is never collected.
    """
    keyed = rows.withColumn("_page", full_trim(F.coalesce("staff_directory", F.lit("")))).where("_page <> ''")
    keyed = keyed.withColumn("_has_id", full_trim(F.coalesce("ipeds", F.lit(""))) != "")
    best = keyed.groupBy("_page").agg(
        F.min_by(F.struct(F.col("_has_id").alias("has_id"), F.col(order).alias("ord"), F.col("base_url").alias("base_url")), F.struct(~F.col("_has_id"), F.col(order))).alias("_best")
    )
    other_site = F.col("_has_id") & F.col("_best.has_id") & ~F.col("base_url").eqNullSafe(F.col("_best.base_url"))
    return keyed.join(detach(best), "_page").where((F.col(order) == F.col("_best.ord")) | other_site).select(*rows.columns)


def processed_this_month(now: Column, tz: str = "America/New_York") -> Column:
    """False also for directories that were never processed."""
    same = local_year_month(F.col("last_processed_at"), tz) == local_year_month(now, tz)
    return F.coalesce(same, F.lit(False))


def due_list(registry: DataFrame, now: dt.datetime | Column, tz: str = "America/New_York") -> DataFrame:
    """Active directories not processed in the local month of ``now``, oldest first, never-processed at the top.

    ``rule`` is the remembered rule, or NULL when it failed last time.
    """
    at = now if isinstance(now, Column) else F.lit(now)
    due = registry.where(F.col("is_active") & ~processed_this_month(at, tz))
    return due.withColumn("rule", F.when(~F.coalesce("rule_failed_last_time", F.lit(False)), F.col("successful_rule"))).orderBy(
        F.asc_nulls_first("last_processed_at"), "staff_directory"
    )


def month_status(registry: DataFrame, now: dt.datetime | Column, tz: str = "America/New_York") -> DataFrame:
    at = now if isinstance(now, Column) else F.lit(now)
    done = processed_this_month(at, tz)
    return registry.where("is_active").agg(
        F.count("*").alias("total"), F.count_if(done).alias("processed"), F.count_if(~done).alias("not_processed")
    )


def apply_runs(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """Registry after processing runs (staff_directory, processed_at, success, used_rule, staff_count, known_rule).

    Runs add to the process count; the last run sets the date; the last success sets rule and count.
    The failed flag follows the last run that says anything about the rule: a success clears it,
    a failure sets it only when a known rule had been tried.
    """
    at = F.col("processed_at")
    telling = F.col("success") | F.col("known_rule").isNotNull()
    per = runs.groupBy("staff_directory").agg(
        F.count("*").alias("_runs"), F.max(at).alias("_at"),
        F.max_by(F.struct("used_rule", "staff_count"), F.when(F.col("success"), at)).alias("_good"),
        F.max_by(~F.col("success"), F.when(telling, at)).alias("_failed"),
    )
    joined = registry.join(per, "staff_directory", "left")
    return joined.withColumns(
        {
            "successful_rule": F.when(F.col("_good").isNotNull(), F.col("_good.used_rule")).otherwise(F.col("successful_rule")),
            "last_staff_count": F.when(F.col("_good").isNotNull(), F.col("_good.staff_count")).otherwise(F.col("last_staff_count")),
            "rule_failed_last_time": F.coalesce("_failed", "rule_failed_last_time"),
            "last_processed_at": F.coalesce("_at", "last_processed_at"),
            "process_count": F.coalesce("process_count", F.lit(0)) + F.coalesce("_runs", F.lit(0)),
        }
    ).select(*registry.columns)


def outcome_counts(runs: DataFrame) -> DataFrame:
    ok = F.col("success")
    return runs.agg(F.count("*").alias("processed"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def successful_urls(registry: DataFrame) -> DataFrame:
    """Directories whose last run did not fail, with ``N/A`` for what is missing."""

    def shown(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("N/A")).alias(c)

    return registry.where(~F.coalesce("rule_failed_last_time", F.lit(True))).select(
        "base_url", "staff_directory", shown("school_name"), shown("successful_rule"), "last_staff_count",
        F.coalesce(F.date_format("last_processed_at", "M/d/yyyy, h:mm:ss a"), F.lit("N/A")).alias("last_processed_at"),
    )


def by_base_url(registry: DataFrame) -> DataFrame:
    """Institution id and school per base URL; of several rows the last registered wins."""
    last = F.max_by(F.struct("ipeds", "school_name"), F.col("staff_directory"))
    return registry.where("base_url <> ''").groupBy("base_url").agg(last.alias("d")).select(
        "base_url", F.coalesce("d.ipeds", F.lit("")).alias("ipeds"), F.coalesce("d.school_name", F.lit("")).alias("school_name")
    )


def registry_of_sites(registry: DataFrame, sites: DataFrame) -> DataFrame:
    """Registry rows that belong to a site by base URL or by staff page."""
    by_base = registry.join(sites.select("base_url"), "base_url", "left_semi")
    by_page = registry.join(sites.select("staff_directory"), "staff_directory", "left_semi")
    return by_base.unionByName(by_page).dropDuplicates(["staff_directory"])
