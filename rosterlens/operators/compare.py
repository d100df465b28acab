"""Differences between consecutive snapshots of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.functions.text import (
    NAME_THRESHOLD, blank_to_null, clean_email, collapse, first_of, full_trim, norm, same_set, same_text, url_key,
)
from rosterlens.operators.flatten import flatten_people
from rosterlens.operators.linking import link_in_order
from rosterlens.operators.nesting import SNAPSHOT, person_rows
from rosterlens.operators.similar import match_names
from rosterlens.operators.snapshots import adjacent_pairs, snapshot_dates
from rosterlens.session import stage

PAIR = ["site_id", "from_date", "to_date"]
PERSON = ["ord", "fingerprint", "name", "title", "emails", "phones", "profile_url", "description", "raw", "categories"]
UNKNOWN_NAME = "Unknown"


def change_id(site: str = "site_id", start: str = "from_date", end: str = "to_date") -> Column:
    return F.md5(F.concat_ws("|", site, F.col(start).cast("string"), F.col(end).cast("string")))


def _scalar(c: Column) -> Column:
    """One text as a diff value: NULL when empty."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.array(c))


def _diff(field: str, changed: Column, before: Column, after: Column) -> Column:
    value = F.struct(F.lit(field).alias("field"), before.alias("before"), after.alias("after"))
    return F.when(changed, value)


def fuzzy_diffs(b: str = "b_", a: str = "a_") -> Column:
    """Trimmed, case-sensitive texts and the case-insensitive category set of a linked pair."""

    def text(field: str) -> Column:
        x, y = F.col(b + field), F.col(a + field)
        changed = full_trim(F.coalesce(x, F.lit(""))) != full_trim(F.coalesce(y, F.lit("")))
        return _diff(field, changed, _scalar(x), _scalar(y))

    x, y = F.col(b + "categories"), F.col(a + "categories")
    categories = _diff("categories", ~same_set(x, y), x, y)
    return F.array_compact(F.array(text("name"), text("title"), text("description"), categories))


def fingerprint_diffs(b: str = "b_", a: str = "a_") -> Column:
    """Six fields of one person, ignoring case, outer space and array order."""

    def text(field: str) -> Column:
        x, y = F.col(b + field), F.col(a + field)
        return _diff(field, ~same_text(x, y), _scalar(x), _scalar(y))

    def many(field: str) -> Column:
        x, y = F.col(b + field), F.col(a + field)
        return _diff(field, ~same_set(x, y), x, y)

    return F.array_compact(
        F.array(text("name"), text("title"), many("emails"), many("phones"), text("profile_url"), many("categories"))
    )


def _role(people: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """People of the ``from`` or ``to`` snapshot of each pair."""
    date = "from_date" if side == "before" else "to_date"
    return people.withColumnRenamed("snapshot_date", date).join(pairs, ["site_id", date]).select(*PAIR, *PERSON)


def _sure_keys(people: DataFrame, out: str) -> DataFrame:
    keys = F.array_compact(
        F.array(
            F.concat(F.lit("e:"), clean_email(first_of(F.col("emails")))),
            F.concat(F.lit("u:"), url_key(F.col("profile_url"))),
        )
    )
    return people.select(*PAIR, F.col("ord").alias(out), F.explode(keys).alias("key"))


def sure_links(before: DataFrame, after: DataFrame) -> DataFrame:
    """Links by equal first email or profile URL. In a flattened snapshot each key has one holder."""
    # Sorted, not broadcast: the planner does not see that people become several keys each.
    pairs = _sure_keys(before, "b").hint("merge").join(_sure_keys(after, "a"), [*PAIR, "key"]).select(*PAIR, "b", "a").distinct()
    return link_in_order(
        pairs.select(*PAIR, F.col("b").alias("v"), F.col("a").alias("w"), F.lit(1.0).alias("score")),
        before.select(*PAIR, F.col("ord").alias("v"), F.col("ord").alias("b")),
        after.select(*PAIR, F.col("ord").alias("w"), F.col("ord").alias("a")),
        PAIR,
    )


def name_links(before: DataFrame, after: DataFrame, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """Links by the most similar name; people of one name share a queue."""
    b = before.where(F.coalesce("name", F.lit("")) != "").select(*PAIR, norm(F.col("name")).alias("v"), F.col("ord").alias("b"))
    a = after.where(F.coalesce("name", F.lit("")) != "").select(*PAIR, norm(F.col("name")).alias("w"), F.col("ord").alias("a"))
    b, a = stage(b, "before-names"), stage(a, "after-names")
    groups, left, right, pairs = match_names(b, a, PAIR, threshold)
    b = b.join(groups, PAIR).join(left.drop("v_len"), ["_group", "v"]).select("_group", F.col("v_id").alias("v"), "b")
    a = a.join(groups, PAIR).join(right.drop("w_len"), ["_group", "w"]).select("_group", F.col("w_id").alias("w"), "a")
    edges = pairs.select("_group", F.col("v_id").alias("v"), F.col("w_id").alias("w"), "score")
    links = link_in_order(edges, stage(b, "before-numbers"), stage(a, "after-numbers"), ["_group"], rounds_before_finish=0)
    return links.join(groups, "_group").select(*PAIR, "b", "a")


def _plain_entries(people: DataFrame, kind: str) -> DataFrame:
    return people.select(
        *PAIR, F.lit(kind).alias("kind"), "ord", "fingerprint",
        collapse(F.coalesce("name", F.lit(""))).alias("name"), collapse(F.coalesce("title", F.lit(""))).alias("title"),
        "categories", "emails", "phones", "profile_url", "raw",
    )


def _side(people: DataFrame, prefix: str, key: str) -> DataFrame:
    return people.select(*PAIR, F.col("ord").alias(key), *[F.col(c).alias(prefix + c) for c in PERSON])


def compare_fuzzy(members: DataFrame, pairs: DataFrame | None = None, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """Added, removed and updated people of every snapshot pair, without relying on fingerprints."""
    if pairs is None:
        pairs = adjacent_pairs(snapshot_dates(members))
    people = stage(flatten_people(members), "people")
    before, after = _role(people, pairs, "before"), _role(people, pairs, "after")
    sure = stage(sure_links(before, after), "sure-links")
    left_b = before.join(sure.withColumnRenamed("b", "ord"), [*PAIR, "ord"], "left_anti")
    left_a = after.join(sure.withColumnRenamed("a", "ord"), [*PAIR, "ord"], "left_anti")
    by_name = stage(name_links(left_b, left_a, threshold), "name-links")

    linked = (
        sure.unionByName(by_name)
        .join(_side(before, "b_", "b"), [*PAIR, "b"])
        .join(_side(after, "a_", "a"), [*PAIR, "a"])
        .withColumn("diffs", fuzzy_diffs())
        .where(F.size("diffs") > 0)
    )
    name = F.coalesce(
        *[blank_to_null(c) for c in (F.col("a_name"), F.col("b_name"), F.col("a_raw")["name"], F.col("b_raw")["name"])],
        F.lit(UNKNOWN_NAME),
    )
    updated = linked.select(
        *PAIR, F.lit("updated").alias("kind"), F.col("b").alias("ord"),
        F.coalesce(blank_to_null(F.col("b_fingerprint")), F.col("a_fingerprint")).alias("fingerprint"),
        collapse(name).alias("name"), F.lit(None).cast("string").alias("title"), F.col("a_categories").alias("categories"),
        F.coalesce("a_emails", "b_emails").alias("emails"), F.coalesce("a_phones", "b_phones").alias("phones"),
        F.coalesce(blank_to_null(F.col("a_profile_url")), F.col("b_profile_url")).alias("profile_url"), "diffs",
        F.coalesce("a_raw", "b_raw").alias("raw"),
    )
    gone = left_b.join(by_name.withColumnRenamed("b", "ord"), [*PAIR, "ord"], "left_anti")
    new = left_a.join(by_name.withColumnRenamed("a", "ord"), [*PAIR, "ord"], "left_anti")
    entries = (
        updated.unionByName(_plain_entries(new, "added"), allowMissingColumns=True)
        .unionByName(_plain_entries(gone, "removed"), allowMissingColumns=True)
        .withColumn("change_id", change_id())
    )
    return entries.select("change_id", *[c for c in entries.columns if c != "change_id"])


def compare_by_fingerprint(members: DataFrame) -> DataFrame:
    """Added, removed and updated people by equal fingerprint, for every snapshot pair.

    One row per person and snapshot, then each person's neighbouring snapshots meet in a window
    over that person - no self join. A window row exists per snapshot, not per member row.
    """
    order = Window.partitionBy("site_id").orderBy("snapshot_date")
    numbered = snapshot_dates(members).select(
        *SNAPSHOT, F.row_number().over(order).alias("_no"), F.lag("snapshot_date").over(order).alias("_prev"),
        F.lead("snapshot_date").over(order).alias("_next"),
    )
    people = person_rows(members).join(numbered, SNAPSHOT)
    life = Window.partitionBy("site_id", "fingerprint").orderBy("_no")
    row = F.struct(*[F.col(c) for c in PERSON if c != "fingerprint"])
    seen = people.select(
        *SNAPSHOT, "fingerprint", "_no", "_prev", "_next", row.alias("now"), F.lag(row).over(life).alias("past"),
        (F.lag("_no").over(life) == F.col("_no") - 1).alias("_was_there"),
        (F.lead("_no").over(life) == F.col("_no") + 1).alias("_stays"),
    )
    was_there, stays = (F.coalesce(c, F.lit(False)) for c in ("_was_there", "_stays"))
    sides = [F.col(f"{side}.{c}").alias(p + c) for side, p in (("past", "b_"), ("now", "a_")) for c in ("name", "title", "emails", "phones", "profile_url", "categories")]
    both = seen.where(was_there).select("*", *sides).withColumn("diffs", fingerprint_diffs()).where(F.size("diffs") > 0)

    def entries(rows: DataFrame, kind: str, start: str, end: str) -> DataFrame:
        fields = [c for c in PERSON if c not in ("fingerprint", "description")]
        diffs = F.col("diffs") if kind == "updated" else F.lit(None).cast(both.schema["diffs"].dataType).alias("diffs")
        return rows.select(
            "site_id", F.col(start).alias("from_date"), F.col(end).alias("to_date"), F.lit(kind).alias("kind"),
            "fingerprint", *[F.col(f"now.{c}").alias(c) for c in fields], diffs,
        )

    added = seen.where(~was_there & F.col("_prev").isNotNull())
    removed = seen.where(~stays & F.col("_next").isNotNull())
    result = (
        entries(added, "added", "_prev", "snapshot_date")
        .unionByName(entries(removed, "removed", "snapshot_date", "_next"))
        .unionByName(entries(both, "updated", "_prev", "snapshot_date"))
    )
    return result.withColumn("change_id", change_id())


def side_by_side(members: DataFrame, entries: DataFrame, pair: DataFrame) -> DataFrame:
    """Every member of both snapshots of the given pairs, flagged with what happened to the person."""
    marks = entries.groupBy(*PAIR, "fingerprint").agg(
        *[F.max((F.col("kind") == k).cast("int")).alias(f"_{k}") for k in ("added", "removed", "updated")],
        F.max_by("diffs", (F.col("kind") == "updated").cast("int")).alias("diffs"),
    )

    def side(name: str, date: str) -> DataFrame:
        rows = members.withColumnRenamed("snapshot_date", date).join(pair.select(*PAIR), ["site_id", date])
        return rows.select(*PAIR, F.lit(name).alias("side"), "ord", "fingerprint", "name", "title", "category")

    flagged = side("before", "from_date").unionByName(side("after", "to_date")).join(marks, [*PAIR, "fingerprint"], "left")
    before, after = F.col("side") == "before", F.col("side") == "after"
    return flagged.select(
        *PAIR, "side", "ord", "fingerprint", "name", "title", "category",
        (after & (F.coalesce("_added", F.lit(0)) == 1)).alias("is_added"),
        (before & (F.coalesce("_removed", F.lit(0)) == 1)).alias("is_removed"),
        (F.coalesce("_updated", F.lit(0)) == 1).alias("is_updated"), "diffs",
    )
