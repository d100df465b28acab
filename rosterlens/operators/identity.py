"""Stable person identities and the profile table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.text import blank_to_null, first_of, norm
from rosterlens.operators.connected import label_components
from rosterlens.operators.nesting import SNAPSHOT
from rosterlens.operators.skew import detach
from rosterlens.session import stage


def stateless_fingerprint(email: Column, name: Column) -> Column:
    return F.md5(F.coalesce(blank_to_null(norm(email)), norm(F.coalesce(name, F.lit("")))))


def _known_by_email(profiles: DataFrame) -> DataFrame:
    """Email -> fingerprint; of several owners the one seen last (then the greatest fingerprint)."""
    emails = profiles.select("site_id", "fingerprint", "last_seen_at", F.explode("emails").alias("email"))
    newest = F.max_by("fingerprint", F.struct("last_seen_at", "fingerprint"))
    return (
        emails.select("site_id", "fingerprint", "last_seen_at", norm(F.col("email")).alias("probe"))
        .groupBy("site_id", "probe")
        .agg(newest.alias("by_email"))
    )


def _known_by_name(profiles: DataFrame) -> DataFrame:
    """Name -> fingerprint, over profiles that have no email."""
    bare = profiles.where((F.coalesce(F.size("emails"), F.lit(0)) <= 0) & (F.col("canonical_name") != ""))
    newest = F.max_by("fingerprint", F.struct("last_seen_at", "fingerprint"))
    return (
        bare.select("site_id", "fingerprint", "last_seen_at", norm(F.col("canonical_name")).alias("probe"))
        .groupBy("site_id", "probe")
        .agg(newest.alias("by_name"))
    )


def _lookup(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Left lookup by (site, key). Rows without a key are spread over all tasks instead of sharing one."""
    spread = F.concat(F.lit("\u0001"), F.xxhash64(*SNAPSHOT, "ord").cast("string"))
    probed = rows.withColumn("probe", F.coalesce(F.col(key), spread))
    return probed.join(detach(known), ["site_id", "probe"], "left").drop("probe")


def resolve_identity(people: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add ``fingerprint``: known email, else known name without email, else a hash of email or name.

    ``people`` has site_id, snapshot_date, ord, name, email. A row with neither email nor name
    gets a hash of its position, so that a rerun gives the same result.
    """
    keyed = people.withColumn("_email", blank_to_null(norm(F.col("email")))).withColumn(
        "_name", blank_to_null(norm(F.col("name")))
    )
    found = _lookup(_lookup(keyed, "_email", _known_by_email(profiles)), "_name", _known_by_name(profiles))
    fresh = F.coalesce(
        F.md5("_email"), F.md5("_name"), F.md5(F.concat_ws("|", "site_id", F.col("snapshot_date").cast("string"), "ord"))
    )
    # A match by email counts for rows that have one; without a key the lookup found nothing.
    return found.withColumn("fingerprint", F.coalesce("by_email", "by_name", fresh)).drop(
        "_email", "_name", "by_email", "by_name"
    )


_SIGHT = [*SNAPSHOT, "_email", "_name"]


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def replay(dates: Iterator[tuple[object, list[tuple[str | None, str | None, int]]]]) -> Iterator[tuple[object, str, str | None, str]]:
    """The rule, date by date, for sights (email, name, last position) that share no key with others: (date, email, name, fingerprint) of those with an email.

    What is kept is the newest sight of every fingerprint, and who has an email now.
    """
    newest: dict[str, tuple[str | None, object]] = {}
    owners: dict[str, set[str]] = {}
    for date, sights in dates:
        latest: dict[str, tuple[int, str | None]] = {}
        for email, name, position in sights:
            if email is None:
                found = _md5(name)
            else:
                known = owners.get(email)
                by_name = _md5(name) if name is not None else None
                if known:
                    found = max(known, key=lambda f: (newest[f][1], f))
                elif by_name in newest and newest[by_name][0] is None:
                    found = by_name
                else:
                    found = _md5(email)
                yield date, email, name, found
            if found not in latest or latest[found][0] < position:
                latest[found] = (position, email)
        for found, (_, email) in latest.items():
            before = newest.get(found, (None, None))[0]
            if before is not None:
                owners[before].discard(found)
            newest[found] = (email, date)
            if email is not None:
                owners.setdefault(email, set()).add(found)


def _replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components one after the other, each as a stream of dates."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from batch[["root", "site_id", "snapshot_date", "_email", "_name", "last"]].astype(object).where(batch.notna(), None).itertuples(index=False, name=None)

    block = []
    for (_, site), part in groupby(rows(), key=lambda r: r[:2]):
        dates = ((date, [(r[3], r[4], r[5]) for r in same]) for date, same in groupby(part, key=lambda r: r[2]))
        for found in replay(dates):
            block.append((site, *found))
            if len(block) == 10_000:
                yield pd.DataFrame(block, columns=[*_SIGHT, "_linked"])
                block = []
    yield pd.DataFrame(block, columns=[*_SIGHT, "_linked"])


def resolve_history(people: DataFrame) -> DataFrame:
    """Add ``fingerprint`` to all rows of whole sites, as ``resolve_identity`` and ``upsert_profiles`` in turn for every date would.

    Rows without an email are known by their name, and most rows with one by the email: that
    depends on no other row. Only a name that stands both with and without an email can hand its identity on. The
    emails and names that such names connect are components of a small graph (found by pointer
    jumping, in rounds that grow with the logarithm of the longest chain, not with the dates), and
    each component is replayed once as a stream of its dates. Rows of one date, email and name count
    once there. A task keeps one entry for each email and name of the component at hand.
    """
    keyed = people.withColumn("_email", blank_to_null(norm(F.col("email")))).withColumn("_name", blank_to_null(norm(F.col("name"))))
    sights = keyed.where("_email is not null or _name is not null").groupBy(*_SIGHT).agg(F.max("ord").alias("last"))
    sights = stage(sights.withColumn("_e", F.md5("_email")).withColumn("_n", F.md5("_name")), "sights")
    with_email, bare = sights.where("_email is not null"), sights.where("_email is null")
    key = ["site_id", "_k"]
    used = with_email.select("site_id", F.explode(F.array_compact(F.array("_e", "_n"))).alias("_k")).distinct()
    mixed = stage(bare.select("site_id", F.col("_n").alias("_k")).distinct().join(used, key), "mixed-names")
    fresh = F.coalesce(
        F.md5("_email"), F.md5("_name"), F.md5(F.concat_ws("|", "site_id", F.col("snapshot_date").cast("string"), "ord"))
    )
    if mixed.isEmpty():
        return keyed.withColumn("fingerprint", fresh).drop("_email", "_name")

    def node(k: str) -> Column:
        return F.concat_ws("|", "site_id", k)

    named = detach(mixed.select("site_id", F.col("_k").alias("_n"), F.lit(True).alias("_by_name")))
    own = detach(mixed.select("site_id", F.col("_k").alias("_e"), F.lit(True).alias("_by_email")))
    touched = with_email.join(named, ["site_id", "_n"], "left").join(own, ["site_id", "_e"], "left").where("_by_name or _by_email")
    edges = touched.select(node("_e").alias("a"), F.when(F.col("_by_name"), node("_n")).otherwise(node("_e")).alias("b")).distinct()
    roots = stage(label_components(edges), "components")
    home = detach(roots.withColumnRenamed("node", "_node"))
    told = with_email.withColumn("_node", node("_e")).unionByName(bare.withColumn("_node", node("_n"))).join(home, "_node")
    ordered = told.select("root", *_SIGHT, "last").repartition("root").sortWithinPartitions("root", "site_id", "snapshot_date")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.select(*_SIGHT).schema)
    linked = stage(ordered.mapInPandas(_replayed, f"{kinds}, _linked string"), "replayed")
    probe = {"_pe": F.coalesce("_email", F.concat(F.lit("\u0001"), F.xxhash64(*SNAPSHOT, "ord").cast("string"))), "_pn": F.coalesce("_name", F.lit("\u0001"))}
    found = linked.select(*SNAPSHOT, F.col("_email").alias("_pe"), F.coalesce("_name", F.lit("\u0001")).alias("_pn"), "_linked")
    rows = keyed.withColumns(probe).join(detach(found), [*SNAPSHOT, "_pe", "_pn"], "left")
    return rows.withColumn("fingerprint", F.coalesce("_linked", fresh)).select(*people.columns, "fingerprint")


def to_members(people: DataFrame) -> DataFrame:
    """Extracted rows (one email, one phone) to member rows with arrays."""

    def as_array(c: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.array(c)).otherwise(F.array().cast("array<string>"))

    return people.select(
        *SNAPSHOT, "ord", "fingerprint", "name", "title", as_array("email").alias("emails"),
        as_array("phone").alias("phones"), "profile_url", F.lit(None).cast("string").alias("description"),
        F.coalesce(blank_to_null(F.col("category")), F.lit("default")).alias("category"),
        F.map_filter(
            F.create_map(
                F.lit("name"), F.col("name"), F.lit("title"), F.col("title"), F.lit("email"), F.col("email"),
                F.lit("phone"), F.col("phone"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("raw"),
    )


def profiles_from(members: DataFrame) -> DataFrame:
    """Profiles as the members alone show them: newest values, first and last sight.

    Inside one snapshot the last row of a person wins, as it does when rows are written in order.
    """
    fields = ["profile_url", "name", "title", "emails", "phones", "raw"]
    per_snapshot = members.groupBy(*SNAPSHOT, "fingerprint").agg(
        F.max_by(F.struct(*fields), F.col("ord")).alias("p"),
        F.array_sort(F.collect_set("category")).alias("categories"),
    )
    newest = F.max_by(F.struct("p", "categories"), F.col("snapshot_date"))
    seen = per_snapshot.groupBy("site_id", "fingerprint").agg(
        newest.alias("n"), F.min("snapshot_date").alias("first_seen_at"), F.max("snapshot_date").alias("last_seen_at")
    )
    return seen.select(
        "site_id", "fingerprint", "n.p.profile_url", F.col("n.p.name").alias("canonical_name"), "n.p.title",
        "n.p.emails", "n.p.phones", "first_seen_at", "last_seen_at", "n.categories", "n.p.raw",
    )


def upsert_profiles(profiles: DataFrame, members: DataFrame) -> DataFrame:
    """New profile table: the newest sight gives the values, the first sight is never moved forward."""
    both = profiles.unionByName(profiles_from(members))
    values = [c for c in both.columns if c not in ("site_id", "fingerprint", "first_seen_at", "last_seen_at")]
    merged = both.groupBy("site_id", "fingerprint").agg(
        F.max_by(F.struct(*values), F.col("last_seen_at")).alias("v"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    )
    return merged.select(
        "site_id", "fingerprint", *[f"v.{c}" for c in values], "first_seen_at", "last_seen_at"
    ).select(*both.columns)


def backfill_categories(profiles: DataFrame, members: DataFrame, latest: DataFrame) -> DataFrame:
    """Categories of known profiles from the latest snapshot of their site; never adds a profile."""
    current = members.join(latest, SNAPSHOT, "left_semi")
    found = current.groupBy("site_id", "fingerprint").agg(F.array_sort(F.collect_set("category")).alias("_new"))
    return profiles.join(found, ["site_id", "fingerprint"], "left").withColumn(
        "categories", F.coalesce("_new", "categories")
    ).drop("_new")


def primary(c: str) -> Column:
    """First element of a contact array, or empty text."""
    return F.coalesce(first_of(F.col(c)), F.lit(""))
