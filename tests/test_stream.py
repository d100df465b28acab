"""The stream leaves what a batch job over the same rows would."""

import datetime as dt
import random
from pathlib import Path

import pytest
from helpers import D1, D2, D3
from pyspark.sql import functions as F

from rosterlens.operators import connected
from rosterlens.operators.identity import profiles_from, replay, resolve_history, resolve_identity, to_members, upsert_profiles
from rosterlens.schemas import PROFILES
from rosterlens.session import app_folder
from rosterlens.sources.tables import bucket_of, write_buckets
from rosterlens.streaming import intake as intake_module
from rosterlens.streaming.intake import PEOPLE_SCHEMA, Intake


def row(site, date, n, name, email=None, title=None, category="A"):
    return (site, date, n, name, title, email, None, category, None)


FIRST = [row("a", D1, 0, "Ida Test"), row("a", D1, 1, "Jon Example"), row("b", D1, 0, "Kay Person", "k@ex.test")]
SECOND = [row("a", D2, 0, "Ida Test", "ida@ex.test"), row("a", D2, 1, "Jon Exampla"), row("a", D2, 2, "New Face")]
THIRD = [row("a", D3, 0, "Ida Test", "ida@ex.test"), row("b", D2, 0, "Kay Newname", "k@ex.test")]


def put(spark, folder, rows):
    spark.createDataFrame(rows, PEOPLE_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def state(intake):
    logs = {(r.site_id, r.from_date, r.to_date): (r.added_count, r.removed_count, r.updated_count) for r in intake.change_log().collect()}
    people = {(r.site_id, r.fingerprint, r.canonical_name, r.first_seen_at, r.last_seen_at) for r in intake.profiles().collect()}
    return logs, people, intake.members().count(), intake.entries().count()


def run(intake, source, checkpoint):
    query = intake.start(source, checkpoint)
    query.awaitTermination()


def test_stream_equals_one_batch(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    intake = Intake(spark, root)
    for rows in (FIRST, SECOND, THIRD):
        put(spark, source, rows)
        run(intake, source, str(tmp_path / "cp"))
    logs, people, members, entries = state(intake)
    # Site a keeps its second and third snapshot, so the first log is gone with the first snapshot.
    assert logs == {("a", D2, D3): (0, 2, 0), ("b", D1, D2): (0, 0, 1)}
    assert members == 6 and entries == 3
    ida = {p[1] for p in people if p[2] == "Ida Test"}
    assert len(ida) == 1, "a name-only person keeps the identity when an email appears"

    whole = Intake(spark, str(tmp_path / "whole"))
    batch = spark.createDataFrame(FIRST + SECOND + THIRD, PEOPLE_SCHEMA)
    whole.take(batch)
    assert state(whole) == (logs, people, members, entries)
    whole.take(batch)
    assert state(whole) == (logs, people, members, entries), "a batch that comes again changes nothing"


def test_split_and_late_snapshots_leave_what_one_batch_does(spark, tmp_path):
    rows = FIRST + SECOND + THIRD
    whole = Intake(spark, str(tmp_path / "whole"))
    whole.take(spark.createDataFrame(rows, PEOPLE_SCHEMA))
    parts = Intake(spark, str(tmp_path / "parts"))
    # snapshots in pieces, the newest first, a piece twice
    for piece in (rows[4:], rows[4:], rows[:4]):
        parts.take(spark.createDataFrame(piece, PEOPLE_SCHEMA))
    assert state(parts) == state(whole)
    listed = [sorted(map(str, t.select("site_id", "snapshot_date", "ord", "fingerprint").collect())) for t in (parts.members(), whole.members())]
    assert listed[0] == listed[1]
    assert parts.arrivals().count() == len(rows)


def test_equal_order_numbers_lose_no_row(spark, tmp_path):
    """Files of one snapshot may each count from 0: rows are told apart by their content."""
    first = [row("a", D1, 0, "Ida Test"), row("a", D1, 0, "Jon Example")]
    third = [row("a", D1, 0, "Kay Person", "k@ex.test"), row("b", D1, 3, "Lone")]
    intake = Intake(spark, str(tmp_path / "out"), buckets=4)
    for rows in (first, third):
        intake.take(spark.createDataFrame(rows, PEOPLE_SCHEMA))
    assert intake.arrivals().count() == 4 and intake.members().where("site_id = 'a'").count() == 3
    assert sorted(r.ord for r in intake.members().collect()) == [0, 1, 2, 3]
    assert {(r.site_id, r.fingerprint) for r in intake.profiles().collect()} == {(r.site_id, r.fingerprint) for r in intake.members().collect()}
    assert Intake(spark, str(tmp_path / "out")).buckets == 4, "the layout is kept"


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    sites = [f"site-{i}" for i in range(40)]
    intake = Intake(spark, str(tmp_path / "out"), buckets=8)
    intake.take(spark.createDataFrame([row(x, D1, 0, f"Person of {x}") for x in sites], PEOPLE_SCHEMA))
    before = {name: set(table().inputFiles()) for name, table in (("members", intake.members), ("profiles", intake.profiles), ("arrivals", intake.arrivals))}
    [number] = [r[0] for r in spark.createDataFrame([(sites[0],)], "s string").select(bucket_of(F.col("s"), 8)).collect()]
    plan = intake.members([number])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and f"= {number})" in plan
    intake.take(spark.createDataFrame([row(sites[0], D2, 0, "Person of site-0"), row(sites[0], D2, 1, "New Face")], PEOPLE_SCHEMA))
    for name, table in (("members", intake.members), ("profiles", intake.profiles), ("arrivals", intake.arrivals)):
        files = set(table().inputFiles())
        assert {f for f in before[name] - files} <= {f for f in before[name] if f"bucket={number}/" in f}, name
        assert {f for f in files - before[name]} and all(f"bucket={number}/" in f for f in files - before[name]), name
    assert intake.members().count() == 42 and {r.site_id for r in intake.members().collect()} == set(sites)


def test_failure_between_two_writes_is_repaired(spark, tmp_path, monkeypatch):
    """The logs are written when the members fail; the batch comes again. Nothing that was staged stays behind."""

    def staged():
        folder = Path(app_folder(spark))
        return len(list(folder.iterdir())) if folder.exists() else 0

    def failing(df, path, *args):
        if path.endswith("/members"):
            raise OSError("lost")
        write_buckets(df, path, *args)

    before = staged()
    intake, second = Intake(spark, str(tmp_path / "out")), spark.createDataFrame(SECOND, PEOPLE_SCHEMA)
    intake.take(spark.createDataFrame(FIRST, PEOPLE_SCHEMA))
    with monkeypatch.context() as patch:
        patch.setattr(intake_module, "write_buckets", failing)
        with pytest.raises(OSError, match="lost"):
            intake.take(second)
    assert intake.members().count() == 3 and intake.arrivals().count() == 3
    intake.take(second)
    # Ida is linked by name and her email is no field of the fuzzy diff; Jon's name changed; one is new
    logs, people, members, entries = state(intake)
    assert logs == {("a", D1, D2): (1, 0, 1)} and (members, entries) == (6, 2)
    assert sum(p[2] == "Ida Test" for p in people) == 1 and intake.arrivals().count() == 6
    intake.take(second)
    assert state(intake) == (logs, people, members, entries) and staged() == before


def by_dates(people, spark):
    """The rule, one date after the other."""
    profiles = spark.createDataFrame([], PROFILES)
    found = []
    for date in sorted({r.snapshot_date for r in people.select("snapshot_date").distinct().collect()}):
        members = to_members(resolve_identity(people.where(F.col("snapshot_date") == date), profiles))
        rows = members.collect()
        found += rows
        members = spark.createDataFrame(rows, members.schema)
        profiles = spark.createDataFrame(upsert_profiles(profiles, members).collect(), PROFILES)
    return {(r.site_id, r.snapshot_date, r.ord, r.fingerprint) for r in found}, {tuple(r[:2]) + (r.canonical_name, tuple(r.emails)) for r in profiles.collect()}


def random_people(seed, dates, sites, rows, names, emails):
    rng = random.Random(seed)
    for s in range(sites):
        for d in range(dates):
            for n in range(rng.randint(0, rows)):
                email = rng.choice([None, None, ""] + emails)
                yield row(f"s{s}", D1 + dt.timedelta(days=d), n, rng.choice([None, " ", *names]), email)


def test_history_in_one_pass_is_the_rule_date_by_date(spark):
    """Few names and emails, so that identities are handed on, lost and met again; one name reads like an email."""
    rows = list(random_people(5, 9, 12, 6, ["Ann", "Ben", "Cy", "e1@x"], ["e1@x", "e2@x", "E3@x "]))
    people = spark.createDataFrame(rows, PEOPLE_SCHEMA)
    want, profiles = by_dates(people, spark)
    members = to_members(resolve_history(people))
    got = members.collect()
    assert {(r.site_id, r.snapshot_date, r.ord, r.fingerprint) for r in got} == want and len(got) == len(rows)
    assert {tuple(r[:2]) + (r.canonical_name, tuple(r.emails)) for r in profiles_from(members).collect()} == profiles


def test_a_thousand_dates_take_few_rounds(spark, monkeypatch):
    """One site, a thousand dates: a person who is linked at the second date, and names chained through shared emails."""
    rows = [row("s", D1 + dt.timedelta(days=d), 0, "Ida", "ida@x" if d else None) for d in range(1000)]
    rows += [row("s", D1 + dt.timedelta(days=d), 1, f"N{d // 2}", None if d % 4 == 0 else f"m{(d + 1) // 2}@x") for d in range(1000)]
    calls = []
    monkeypatch.setattr(connected, "_jump", lambda p, jump=connected._jump: calls.append(1) or jump(p))
    got = to_members(resolve_history(spark.createDataFrame(rows, PEOPLE_SCHEMA))).collect()
    assert len(got) == 2000 and len({r.fingerprint for r in got if r.name == "Ida"}) == 1
    assert len(calls) <= 12
    per_date = {}
    for r in rows:
        per_date.setdefault(r[1], []).append((r[4 + 1], r[3].lower(), r[2]) if r[5] else (None, r[3].lower(), r[2]))
    want = {(d, e, n): f for d, e, n, f in replay(iter(sorted(per_date.items())))}
    assert all(r.fingerprint == want[r.snapshot_date, r.emails[0], r.name.lower()] for r in got if r.emails)


def test_components_by_pointer_jumping(spark):
    rng = random.Random(1)
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(300)] + [(f"x{rng.randint(0, 60)}", f"x{rng.randint(0, 60)}") for _ in range(50)]
    home = {}
    for a, b in edges:
        group = home.get(a, {a}) | home.get(b, {b})
        for n in group:
            home[n] = group
    got = {r.node: r.root for r in connected.label_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: min(g) for n, g in home.items()}
    assert connected.label_components(spark.createDataFrame([], "a string, b string")).count() == 0
