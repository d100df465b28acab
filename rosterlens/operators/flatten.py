"""Unique people inside a snapshot.

Members are taken in document order. A member joins the first earlier person with the same
first email, the same profile URL, or the same name and title; else it is a person of its own
(a *leader*). Leaders are found in rounds over (key, member) rows: who stands first in every
one of its keys is a leader, who shares a key with a leader is absorbed, the rest goes on.
A round costs one row per member and key, however many members share a key; no pairs are built.

A person's name and title grow to the longest seen so far, and later members are compared with
the grown texts. The rounds use first texts; ``follow_growth`` then repeats one join step, on
snapshots where a person grew, until nothing moves. Each member depends on earlier ones only,
so the assignment that does not move is the sequential one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.functions.text import clean_email, first_of, norm, url_key
from rosterlens.operators.nesting import SNAPSHOT
from rosterlens.operators.ordered import END, smallest_cover
from rosterlens.operators.skew import detach
from rosterlens.session import drop, stage

# After this many rounds, snapshots with few open rows are finished in one pass each.
ROUNDS_BEFORE_FINISH = 2
SMALL_GROUP_ROWS = 100_000


def name_title_key(name: Column, title: Column) -> Column:
    """Two missing titles are equal, an empty title is not a missing one; a name is required."""
    return F.when(
        F.coalesce(name, F.lit("")) != "",
        F.concat(F.lit("n:"), norm(name), F.when(title.isNull(), F.lit("\u0002")).otherwise(F.concat(F.lit("\u0001"), norm(title)))),
    )


def person_keys(members: DataFrame) -> DataFrame:
    keys = F.array_compact(
        F.array(
            F.concat(F.lit("e:"), clean_email(first_of(F.col("emails")))),
            F.concat(F.lit("u:"), url_key(F.col("profile_url"))),
            name_title_key(F.col("name"), F.col("title")),
        )
    )
    return members.select(*SNAPSHOT, "ord", F.explode(keys).alias("key"))


def _finish_in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Leaders of one small group, by the sequential rule."""
    taken: set[str] = set()
    leaders = []
    for member, keys in rows.groupby("ord", sort=True)["key"]:
        if taken.isdisjoint(keys):
            taken.update(keys)
            leaders.append(member)
    head = rows[SNAPSHOT].iloc[[0] * len(leaders)].reset_index(drop=True)
    return head.assign(ord=leaders).astype({"ord": "int64"})


def find_leaders(shared: DataFrame, rounds_before_finish: int = ROUNDS_BEFORE_FINISH) -> DataFrame:
    """(snapshot, ord) of the leaders among members that share a key; ``shared`` is a staged key table."""
    open_rows, found = shared, []
    member, key = [*SNAPSHOT, "ord"], [*SNAPSHOT, "key"]
    leaders_schema = shared.select(*member).schema
    round_no = 0
    while not open_rows.isEmpty():
        round_no += 1
        if round_no > rounds_before_finish:
            sizes = open_rows.groupBy(*SNAPSHOT).agg(F.count("*").alias("_n"))
            small = sizes.where(F.col("_n") <= SMALL_GROUP_ROWS).select(*SNAPSHOT)
            found.append(
                stage(
                    open_rows.join(small, SNAPSHOT, "left_semi")
                    .groupBy(*SNAPSHOT)
                    .applyInPandas(_finish_in_order, leaders_schema),
                    "leaders",
                )
            )
            open_rows = stage(open_rows.join(small, SNAPSHOT, "left_anti"), "open-members")
            if open_rows.isEmpty():
                break
        firsts = open_rows.groupBy(*key).agg(F.min("ord").alias("_first"))
        stands_first = F.min((F.col("ord") == F.col("_first")).cast("int"))
        leaders = stage(
            open_rows.join(detach(firsts), key).groupBy(*member).agg(stands_first.alias("_ok")).where("_ok = 1").drop("_ok"),
            "leaders",
        )
        found.append(leaders)
        led_keys = open_rows.join(leaders, member, "left_semi").select(*key)
        settled = open_rows.join(led_keys, key, "left_semi").select(*member).distinct()
        last = open_rows
        open_rows = stage(last.join(settled, member, "left_anti"), "open-members")
        if round_no > 1:
            drop(last)
    result = found[0] if found else shared.select(*member).limit(0)
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def first_leaders(members: DataFrame) -> DataFrame:
    """Add ``leader`` by first texts: the ``ord`` of the person each member row belongs to."""
    member, key = [*SNAPSHOT, "ord"], [*SNAPSHOT, "key"]
    keys = person_keys(members)
    spread = keys.groupBy(*key).agg(F.min("ord").alias("_lo"), F.max("ord").alias("_hi")).where("_lo < _hi")
    shared = stage(keys.join(detach(spread.select(*key)), key, "left_semi"), "shared-keys")
    leaders = find_leaders(shared)
    # A key has one leader at most, as any later holder is absorbed by it.
    led = shared.join(leaders, member, "left_semi").select(*key, F.col("ord").alias("_leader"))
    chosen = shared.join(led, key).groupBy(*member).agg(F.min("_leader").alias("leader"))
    return members.join(chosen, member, "left").withColumn("leader", F.coalesce("leader", "ord"))


def _records(assigned: DataFrame, text: str) -> DataFrame:
    """Where a person's text becomes longer than any before: at most one row per text length."""
    by_length = (
        assigned.where(F.length(text) > 0)
        .groupBy(*SNAPSHOT, "leader", F.length(text).alias("_n"))
        .agg(F.min(F.struct("ord", text)).alias("_s"))
    )
    before = Window.partitionBy(*SNAPSHOT, "leader").orderBy("_s.ord").rowsBetween(Window.unboundedPreceding, -1)
    longest = F.coalesce(F.max("_n").over(before), F.lit(0))
    return (
        by_length.withColumn("_longest", longest)
        .where("_n > _longest and _s.ord > leader")
        .select(*SNAPSHOT, "leader", "_s.ord", F.struct(F.col(f"_s.{text}").alias("v")).alias(text))
    )


def name_title_spans(assigned: DataFrame, growth: DataFrame) -> DataFrame:
    """(snapshot, key, low, high, owner): the key a person answers to, for members in (low, high].

    Only people that grew need their steps put in order; the others answer to one key for good.
    """
    person = [*SNAPSHOT, "leader"]
    own = assigned.where("ord = leader").select(*person, "ord", "name", "title")
    grown = growth.select(*person).distinct()
    still = own.join(grown, person, "left_anti").select(
        *SNAPSHOT, "name", "title", F.col("ord").alias("low"), F.lit(END).alias("high"), F.col("leader").alias("owner")
    )
    first = own.join(grown, person, "left_semi").select(
        *person, "ord", *[F.struct(F.col(c).alias("v")).alias(c) for c in ("name", "title")]
    )
    steps = first.unionByName(growth).groupBy(*person, "ord").agg(F.max("name").alias("name"), F.max("title").alias("title"))
    line = Window.partitionBy(*person).orderBy("ord")
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moving = steps.select(
        *SNAPSHOT, *[F.last(c, ignorenulls=True).over(so_far)["v"].alias(c) for c in ("name", "title")],
        F.col("ord").alias("low"), F.coalesce(F.lead("ord").over(line), F.lit(END)).alias("high"), F.col("leader").alias("owner"),
    )
    return still.unionByName(moving).select(
        *SNAPSHOT, name_title_key(F.col("name"), F.col("title")).alias("key"), "low", "high", "owner"
    ).where("key is not null")


def _growth(assigned: DataFrame) -> DataFrame:
    return _records(assigned, "name").unionByName(_records(assigned, "title"), allowMissingColumns=True)


def _reassign(assigned: DataFrame, growth: DataFrame) -> DataFrame:
    """One step: every member joins the smallest earlier leader that answers to one of its keys."""
    key, rows = [*SNAPSHOT, "key"], assigned.drop("leader")
    keys = person_keys(rows)
    fixed = keys.where(~F.col("key").startswith("n:"))
    owners = fixed.join(assigned.where("ord = leader").select(*SNAPSHOT, "ord"), [*SNAPSHOT, "ord"], "left_semi")
    owners = owners.groupBy(*key).agg(F.min("ord").alias("owner"))
    by_key = fixed.join(detach(owners), key).where("owner < ord").select(*SNAPSHOT, "ord", "owner")
    points = keys.where(F.col("key").startswith("n:")).select(*key, "ord")
    spans = stage(name_title_spans(assigned, growth), "spans")
    by_name = smallest_cover(points, spans, key).select(*SNAPSHOT, "ord", "owner")
    best = by_key.unionByName(by_name).groupBy(*SNAPSHOT, "ord").agg(F.min("owner").alias("leader"))
    return rows.join(best, [*SNAPSHOT, "ord"], "left").withColumn("leader", F.coalesce("leader", "ord"))


def follow_growth(assigned: DataFrame) -> DataFrame:
    """Correct ``leader`` for people whose name or title grew inside the snapshot."""
    assigned = stage(assigned, "first-leaders")
    growth = stage(_growth(assigned), "growth")
    if growth.isEmpty():
        return assigned
    touched = growth.select(*SNAPSHOT).distinct()
    done, current = [assigned.join(touched, SNAPSHOT, "left_anti")], assigned.join(touched, SNAPSHOT, "left_semi")
    while True:
        step = stage(_reassign(current, growth), "leaders-step")
        old = current.select(*SNAPSHOT, "ord", F.col("leader").alias("_old"))
        moved = step.join(old, [*SNAPSHOT, "ord"]).where("leader <> _old").select(*SNAPSHOT).distinct()
        moved = stage(moved, "moved")
        done.append(step.join(moved, SNAPSHOT, "left_anti"))
        if moved.isEmpty():
            break
        current = step.join(moved, SNAPSHOT, "left_semi")
        growth = stage(_growth(current), "growth")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def assign_leaders(members: DataFrame) -> DataFrame:
    """Add ``leader``: the ``ord`` of the person each member row belongs to."""
    slim = members.select(*SNAPSHOT, "ord", "name", "title", F.slice("emails", 1, 1).alias("emails"), "profile_url")
    leaders = follow_growth(first_leaders(slim)).select(*SNAPSHOT, "ord", "leader")
    return members.join(leaders, [*SNAPSHOT, "ord"])


def merge_people(assigned: DataFrame) -> DataFrame:
    """One row per leader: its own fields, the longest name and title, distinct categories in order."""
    own = F.col("ord") == F.col("leader")
    fields = ["fingerprint", "emails", "phones", "profile_url", "description", "raw"]
    size = {c: F.length(F.coalesce(c, F.lit(""))) for c in ("name", "title")}
    per_category = (
        assigned.withColumn("_norm", norm(F.col("category")))
        .groupBy(*SNAPSHOT, "leader", "_norm")
        .agg(
            F.max(F.when(own, F.struct(*[F.col(c) for c in ("name", "title")]))).alias("_own_text"),
            F.min_by(F.when(own, F.struct(*fields)), F.when(own, F.col("ord"))).alias("_own"),
            *[
                F.max_by(
                    F.struct(size[c].alias("n"), (-F.col("ord")).alias("o"), F.col(c).alias("v")),
                    F.struct(size[c], -F.col("ord")),
                ).alias(f"_{c}")
                for c in ("name", "title")
            ],
            F.min(F.struct("ord", "category")).alias("_category"),
        )
    )
    best = {c: F.max(F.struct(f"_{c}.n", f"_{c}.o", f"_{c}.v")) for c in ("name", "title")}
    people = per_category.groupBy(*SNAPSHOT, "leader").agg(
        F.max("_own_text").alias("_own_text"),
        F.min_by("_own", F.col("_category.ord")).alias("_own"),
        *[best[c].alias(f"_{c}") for c in best],
        F.array_sort(F.collect_list("_category")).alias("_categories"),
    )

    def longest(c: str) -> Column:
        return F.when(F.col(f"_{c}.n") > 0, F.col(f"_{c}.v")).otherwise(F.col(f"_own_text.{c}")).alias(c)

    return people.select(
        *SNAPSHOT, F.col("leader").alias("ord"), longest("name"), longest("title"), "_own.*",
        F.col("_categories.category").alias("categories"),
    )


def flatten_people(members: DataFrame) -> DataFrame:
    """Unique people of every snapshot, all sites and dates in the same rounds."""
    return merge_people(assign_leaders(members))
