"""Change logs: built from entries, rebuilt in full, for one site, or for what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.operators.compare import PAIR, change_id, compare_fuzzy

MODES = ["full", "site", "resume"]


def build_change_log(entries: DataFrame) -> DataFrame:
    """One log per snapshot pair that has entries; its date is that of the later snapshot."""
    counts = [F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("added", "removed", "updated")]
    logs = entries.groupBy(*PAIR).agg(*counts)
    return logs.select(
        change_id().alias("change_id"), *PAIR, F.col("to_date").alias("created_at"), "added_count", "removed_count", "updated_count"
    )


def reprocess(
    members: DataFrame, change_log: DataFrame | None = None, mode: str = "full", site_id: str | None = None, threshold: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """(change log, entries) computed anew.

    ``full`` takes all sites, ``site`` one, ``resume`` those without any log yet. The result holds the
    processed sites only; writing it by site replaces theirs and leaves the others.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "site":
        members = members.where(F.col("site_id") == site_id)
    elif mode == "resume" and change_log is not None:
        members = members.join(change_log.select("site_id").distinct(), "site_id", "left_anti")
    options = {} if threshold is None else {"threshold": threshold}
    entries = compare_fuzzy(members, **options)
    return build_change_log(entries), entries
