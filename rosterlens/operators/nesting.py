"""Between nested snapshot documents and flat member rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.operators.ordered import grouped_rank

SNAPSHOT = ["site_id", "snapshot_date"]
MEMBER_FIELDS = ["fingerprint", "name", "title", "emails", "phones", "profile_url", "description", "raw"]
DEFAULT_CATEGORY = "default"


def snapshot_id(site: str | Column = "site_id", date: str | Column = "snapshot_date") -> Column:
    site_col = F.col(site) if isinstance(site, str) else site
    date_col = F.col(date) if isinstance(date, str) else date
    return F.concat_ws("@", site_col, F.date_format(date_col, "yyyy-MM-dd'T'HH:mm:ss"))


def unnest(snapshots: DataFrame) -> DataFrame:
    """Nested documents to member rows; ``ord`` is the position over all categories of the document."""
    people = F.flatten(
        F.transform(
            F.coalesce("categories", F.array().cast(snapshots.schema["categories"].dataType)),
            lambda c: F.transform(
                F.coalesce(c["members"], F.array()), lambda m: F.struct(c["name"].alias("category"), m.alias("m"))
            ),
        )
    )
    rows = snapshots.select(*SNAPSHOT, F.posexplode(people).alias("ord", "p"))
    return rows.select(
        *SNAPSHOT,
        F.col("ord").cast("long").alias("ord"),
        *[F.col(f"p.m.{f}").alias(f) for f in MEMBER_FIELDS],
        F.col("p.category").alias("category"),
    )


def nest(members: DataFrame, section_size: int = 10_000) -> DataFrame:
    """Member rows to category sections in order of first appearance.

    A section holds at most ``section_size`` members, so no row grows with a hot category;
    ``unnest_sections`` gives the members back. ``count`` is that of the whole category.
    """
    named = members.withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit(DEFAULT_CATEGORY)))
    placed = grouped_rank(named, [*SNAPSHOT, "category"], "ord", out="_place")
    sections = (
        placed.withColumn("section", F.floor((F.col("_place") - 1) / section_size))
        .groupBy(*SNAPSHOT, "category", "section")
        .agg(F.array_sort(
                F.collect_list(F.struct("ord", *MEMBER_FIELDS)), lambda a, b: F.signum(a["ord"] - b["ord"]).cast("int")
            ).alias("members"))
    )
    return sections.join(category_counts(members), [*SNAPSHOT, "category"])


def unnest_sections(sections: DataFrame) -> DataFrame:
    rows = sections.select(*SNAPSHOT, "category", F.explode("members").alias("m"))
    return rows.select(*SNAPSHOT, "m.ord", *[f"m.{f}" for f in MEMBER_FIELDS], "category")


def category_counts(members: DataFrame) -> DataFrame:
    """Members per category of a snapshot, with the category's first position."""
    category = F.coalesce(F.nullif("category", F.lit("")), F.lit(DEFAULT_CATEGORY))
    return members.groupBy(*SNAPSHOT, category.alias("category")).agg(
        F.count("*").alias("count"), F.min("ord").alias("cat_ord")
    )


def snapshot_counts(members: DataFrame) -> DataFrame:
    """One row per snapshot: total and the categories with their counts, in document order."""
    listed = F.array_sort(F.collect_list(F.struct("cat_ord", "category", "count")))
    return (
        category_counts(members)
        .groupBy(*SNAPSHOT)
        .agg(F.sum("count").alias("total_count"), listed.alias("categories"))
    )


def person_rows(members: DataFrame) -> DataFrame:
    """One row per person and snapshot: the first member row and the sorted distinct categories."""
    fields = ["ord", "name", "title", "emails", "phones", "profile_url", "description", "raw"]
    first = F.min_by(F.struct(*fields), F.col("ord"))
    return (
        members.groupBy(*SNAPSHOT, "fingerprint")
        .agg(first.alias("p"), F.array_sort(F.collect_set("category")).alias("categories"))
        .select(*SNAPSHOT, "fingerprint", "p.*", "categories")
    )


def zip_parallel(df: DataFrame, keep: list[str], names: str, **others: str) -> DataFrame:
    """Parallel lists of one row to one row per position; short lists give NULL, nameless rows go."""
    zipped = F.arrays_zip(F.col(names).alias("name"), *[F.col(c).alias(k) for k, c in others.items()])
    rows = df.select(*keep, F.posexplode(zipped).alias("place", "z"))
    return rows.select(*keep, "place", "z.*").where(F.coalesce("name", F.lit("")) != "")


def link_map(links: Column) -> Column:
    """Open object from (platform, link) structs; empty links are dropped and the last one wins."""
    usable = F.filter(links, lambda x: F.coalesce(F.trim(x["link"]), F.lit("")) != "")
    return F.aggregate(
        usable,
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
        lambda acc, x: F.map_concat(
            F.map_filter(acc, lambda k, _: k != x["platform"]), F.create_map(x["platform"], F.trim(x["link"]))
        ),
    )
