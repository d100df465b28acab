"""Search over people in snapshots, suggestions, pages of results."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.contacts import digits
from rosterlens.operators.nesting import SNAPSHOT
from rosterlens.operators.skew import detach
from rosterlens.session import stage

SUGGEST_FIELDS = ["name", "title", "category", "email"]


def contains(c: Column, text: str, regex: bool = False) -> Column:
    """Case-insensitive containment, literal unless ``regex``."""
    if regex:
        return c.rlike(f"(?i){text}")
    return F.contains(F.lower(c), F.lit(text.lower()))


def _any(c: str, test) -> Column:
    return F.coalesce(F.exists(F.col(c), test), F.lit(False))


def person_filter(name=None, email=None, phone=None, title=None, exact=False, regex=False) -> Column:
    """Member-level criteria. Titles always match in part; phones compare digits with digits."""
    tests = []
    if name:
        tests.append(F.col("name") == name if exact else contains(F.col("name"), name, regex))
    if email:
        tests.append(
            F.array_contains("emails", email) if exact else _any("emails", lambda e: contains(e, email, regex))
        )
    if phone:
        wanted = "".join(ch for ch in phone if ch.isdigit())
        tests.append(
            F.array_contains("phones", phone) if exact else _any("phones", lambda p: F.contains(digits(p), F.lit(wanted)))
        )
    if title:
        tests.append(contains(F.col("title"), title, regex))
    keep = F.lit(True)
    for t in tests:
        keep = keep & t
    return keep


def find_site(sites: DataFrame, text: str, regex: bool = False) -> DataFrame:
    """The site whose id is ``text`` or whose URL contains it; of several the first by id."""
    hit = (F.col("site_id") == text) | contains(F.col("base_url"), text, regex)
    return sites.where(hit).orderBy("site_id").limit(1)


def sightings(
    members: DataFrame, sites: DataFrame, *, name=None, email=None, phone=None, title=None, category=None, site=None,
    exact: bool = False, regex: bool = False, category_scope: str = "snapshot",
) -> DataFrame:
    """Where the people that match were seen: one row per fingerprint, site and date, with the first record there as ``p``.

    ``category_scope='snapshot'``: a category criterion selects snapshots that have such a category,
    and all their matching people come back. ``'member'`` applies it to the person's own row.
    """
    rows = members
    if site:
        rows = rows.join(find_site(sites, site, regex).select("site_id"), "site_id", "left_semi")
    if category:
        match = contains(F.col("category"), category, regex)
        if category_scope == "member":
            rows = rows.where(match)
        else:
            rows = rows.join(detach(rows.where(match).select(*SNAPSHOT).distinct()), SNAPSHOT, "left_semi")
    hits = rows.where(person_filter(name, email, phone, title, exact, regex))
    fields = ["name", "title", "emails", "phones", "profile_url", "description", "category"]
    per_snapshot = hits.groupBy(*SNAPSHOT, "fingerprint").agg(F.min_by(F.struct(*fields), F.col("ord")).alias("p"))
    return per_snapshot.join(sites.select("site_id", "base_url", "staff_directory"), "site_id", "left")


def people_of(seen: DataFrame) -> DataFrame:
    """One row per fingerprint: newest record, first and last sight, number of sightings. A combinable aggregate of fixed size."""
    people = seen.groupBy("fingerprint").agg(
        F.max_by("p", F.struct("snapshot_date", "site_id")).alias("p"), F.max("snapshot_date").alias("latest_seen"),
        F.min("snapshot_date").alias("first_seen"), F.count("*").alias("sightings"),
    )
    return people.select("fingerprint", "p.*", "latest_seen", "first_seen", "sightings")


def with_sites(people: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds ``sites``, all (date, site) pairs of each person, oldest first. Meant for a page of people."""
    pair = F.struct("snapshot_date", "site_id", "base_url", "staff_directory")
    listed = seen.join(people.select("fingerprint"), "fingerprint", "left_semi").groupBy("fingerprint").agg(F.array_sort(F.collect_set(pair)).alias("sites"))
    return people.join(listed, "fingerprint")


def search_people(members: DataFrame, sites: DataFrame, **criteria) -> DataFrame:
    """All people that match, each with all its sites; ``search_page`` lists the sites of one page only."""
    seen = sightings(members, sites, **criteria)
    return with_sites(people_of(seen), seen)


@dataclass
class Page:
    """One page of a result and its place among all pages."""

    rows: DataFrame
    current_page: int
    total_pages: int
    total: int
    has_next: bool
    has_prev: bool


def page_rows(result: DataFrame, order: list[Column | str], page: int = 1, limit: int = 20) -> DataFrame:
    """Rows of one page; ``order`` must be total, or pages may overlap."""
    return result.orderBy(*order).offset((page - 1) * limit).limit(limit)


def page_after(result: DataFrame, latest_seen=None, fingerprint: str | None = None, limit: int = 20) -> DataFrame:
    """The people after the given last one of the page before: no page is gathered again, however deep it lies."""
    rows = result
    if fingerprint is not None:
        at = F.lit(latest_seen).cast("timestamp")
        rows = result.where((F.col("latest_seen") < at) | (F.col("latest_seen") == at) & (F.col("fingerprint") > fingerprint))
    return rows.orderBy(F.desc("latest_seen"), "fingerprint").limit(limit)


def totals(result: DataFrame, page: int = 1, limit: int = 20) -> DataFrame:
    """One row: what a result has in all, in pages of ``limit``."""
    pages = F.ceil(F.col("total") / limit).cast("bigint")
    return result.agg(F.count("*").alias("total")).select(
        F.lit(page).cast("bigint").alias("current_page"), pages.alias("total_pages"), "total", (F.lit(page) < pages).alias("has_next"), F.lit(page > 1).alias("has_prev")
    )


def search_page(members: DataFrame, sites: DataFrame, page: int = 1, limit: int = 20, **criteria) -> Page:
    """A page of people with their sites. Page and totals come from one written result."""
    seen = stage(sightings(members, sites, **criteria), "sightings")
    people = stage(people_of(seen), "found-people")
    total = people.count()
    pages = ceil(total / limit)
    rows = with_sites(page_rows(people, [F.desc("latest_seen"), "fingerprint"], page, limit), seen)
    return Page(rows.orderBy(F.desc("latest_seen"), "fingerprint"), page, pages, total, page < pages, page > 1)


def suggest(members: DataFrame, q: str, field: str = "name", k: int = 10, regex: bool = False) -> DataFrame:
    """Most frequent values that contain ``q``. Emails are suggested as the whole list of a row."""
    if field not in SUGGEST_FIELDS:
        raise ValueError(f"field must be one of {SUGGEST_FIELDS}")
    if not q or len(q) < 2:
        return members.select(F.lit("").alias("value"), F.lit(0).cast("bigint").alias("count")).limit(0)
    if field == "email":
        hits = members.where(_any("emails", lambda e: contains(e, q, regex))).select(F.array_join("emails", ", ").alias("value"))
    else:
        hits = members.where(contains(F.col(field), q, regex)).select(F.col(field).alias("value"))
    return hits.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(k)
