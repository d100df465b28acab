"""Compare and identity scenarios with invented people; all sites run in one job."""

import pytest
from helpers import D1, D2, D3, member, members_df

from pyspark.sql import functions as F

from rosterlens.operators import identity, nesting
from rosterlens.operators.compare import compare_by_fingerprint, compare_fuzzy
from rosterlens.operators.snapshots import adjacent_pairs, snapshot_dates
from rosterlens.plans.changes import build_change_log, reprocess
from rosterlens.plans.export import change_code, change_details
from rosterlens.schemas import NESTED_SNAPSHOTS

ANN = dict(name="Ann Example", emails=["ann@ex.test"], fingerprint="ann")


def pair(site, before, after):
    rows = [member(site, D1, i, **p) for i, p in enumerate(before)]
    return rows + [member(site, D2, i, **p) for i, p in enumerate(after)]


def person(name, **kw):
    return dict(name=name, **kw)


SCENARIOS = {
    "S1": ([person("Ann", title="Engineer", category="Eng", fingerprint="f")],
           [person("Ann", title="Manager", emails=["a@ex.test"], category="Lead", fingerprint="f"), person("Ann", title="Manager", emails=["a@ex.test"], category="Eng", fingerprint="f")]),
    "S2": ([person("Ben", title="Tech", fingerprint="f")], [person("Ben", title="Lead Tech", phones=["555-010-0001"], fingerprint="f")]),
    "S3": ([person("Cy", fingerprint="f")], [person("Cy", fingerprint="f"), person("Cy", title="other", fingerprint="g")]),
    "S4": ([person("Di", emails=["d@ex.test"], fingerprint="d"), person("Ed", emails=["e@ex.test"], fingerprint="e")],
           [person("Di", emails=["e@ex.test"], fingerprint="d"), person("Ed", emails=["d@ex.test"], fingerprint="e")]),
    "S5": ([person("Flo", category="A", fingerprint="f"), person("Flo", category="B", fingerprint="f")], [person("Flo", category="A", fingerprint="f")]),
    "S6": ([person("Gus Kim", title="coach", fingerprint="f")], [person(" GUS KIM ", title="Coach", fingerprint="f")]),
    "S7": ([person("Hal", emails=["h@ex.test"], fingerprint="h1")], [person("Hal", emails=["h2@ex.test"], fingerprint="h2")]),
    "S8": ([ANN], [ANN]),
    "S9": ([person("Johnathan Sample", fingerprint="x")], [person("Jonathan Sample", fingerprint="y")]),
    "S10": ([person("Kim Lee", fingerprint="x")], [person("K. Lee", fingerprint="y")]),
    "S11": ([person("Lou Old", emails=["mailto:Lou@ex.test"], fingerprint="x")], [person("Louise Newname", emails=["lou@ex.test "], fingerprint="x")]),
    "S12": ([person("abcdefghijklmnopqrst", fingerprint="x")], [person("abcdefghijklmnopqxyz", fingerprint="y")]),
    "S13": ([person("Mo Testpersona", fingerprint="b")], [person("Mo Testpersonb", title="1", fingerprint="a0"), person("Mo Testpersonc", title="2", fingerprint="a1")]),
    "S14": ([person("No Testpersona", title="1", fingerprint="b0"), person("No Testpersonb", title="2", fingerprint="b1")], [person("No Testpersonc", fingerprint="a")]),
    "URL": ([person("Old Name", url="/p/1/", fingerprint="b")], [person("Other", url="/p/1", fingerprint="a")]),
}


@pytest.fixture(scope="module")
def all_members(spark):
    return members_df(spark, [r for site, (b, a) in SCENARIOS.items() for r in pair(site, b, a)]).cache()


def found(entries):
    out = {}
    for r in entries.collect():
        fields = tuple(d.field for d in r.diffs or [])
        out.setdefault(r.site_id, set()).add((r.kind, r.fingerprint, fields))
    return out


def test_fingerprint_compare(all_members):
    got = found(compare_by_fingerprint(all_members))
    assert got["S1"] == {("updated", "f", ("title", "emails", "categories"))}
    assert got["S2"] == {("updated", "f", ("title", "phones"))}
    assert got["S3"] == {("added", "g", ())}
    assert got["S4"] == {("updated", "d", ("emails",)), ("updated", "e", ("emails",))}
    assert got["S5"] == {("updated", "f", ("categories",))}
    assert got["S7"] == {("added", "h2", ()), ("removed", "h1", ())}
    assert "S6" not in got and "S8" not in got


def test_fuzzy_compare(all_members):
    entries = compare_fuzzy(all_members).cache()
    got = found(entries)
    assert got["S9"] == {("updated", "x", ("name",))}
    assert got["S10"] == {("added", "y", ()), ("removed", "x", ())}
    assert got["S11"] == {("updated", "x", ("name",))}
    assert got["S12"] == {("added", "y", ()), ("removed", "x", ())}
    assert got["S13"] == {("updated", "b", ("name", "title")), ("added", "a1", ())}
    assert got["S14"] == {("updated", "b0", ("name", "title")), ("removed", "b1", ())}
    assert got["URL"] == {("updated", "b", ("name",))}
    assert "S8" not in got
    log = {r.site_id: (r.added_count, r.removed_count, r.updated_count) for r in build_change_log(entries).collect()}
    assert log["S13"] == (1, 0, 1) and "S8" not in log
    shown = {r.site_id: r for r in entries.withColumn("code", change_code()).withColumn("text", change_details()).collect()}
    assert shown["S9"].code == "j" and shown["S9"].text == "name: Johnathan Sample → Jonathan Sample"


def test_reprocess_modes(all_members):
    some = all_members.where("site_id in ('S9', 'S10')")
    log, _ = reprocess(some)
    assert {r.site_id for r in log.collect()} == {"S9", "S10"}
    log, _ = reprocess(some, mode="site", site_id="S9")
    assert {r.site_id for r in log.collect()} == {"S9"}
    log, _ = reprocess(some, change_log=log, mode="resume")
    assert {r.site_id for r in log.collect()} == {"S10"}


def test_large_pair_of_snapshots(spark):
    """21 categories, people in several of them, no URL, many without email: three are new."""

    def roster(date, extra):
        rows, n = [], 0
        for i in range(70 + extra):
            for c in range(1 + (i % 7 == 0)):
                rows.append(member("s", date, n, f"Person {chr(65 + i % 26)}{i:03d} Nr{i * 37}", f"Title {i}", [f"p{i}@ex.test"] if i % 9 < 5 else [], [], f"Cat {(i + c) % 21}", fingerprint=f"f{i}"))
                n += 1
        return rows

    df = members_df(spark, roster(D1, 0) + roster(D2, 3))
    for entries in (compare_fuzzy(df), compare_by_fingerprint(df)):
        assert {r.kind: r["count"] for r in entries.groupBy("kind").count().collect()} == {"added": 3}


def test_pairs_are_neighbours(spark):
    df = members_df(spark, [member("s", d, 0, "Ann") for d in (D1, D3, D2)])
    rows = adjacent_pairs(snapshot_dates(df)).collect()
    assert {(r.from_date, r.to_date) for r in rows} == {(D1, D2), (D2, D3)}


def test_identity(spark):
    known = spark.createDataFrame(
        [("s", "md5-name", "Ida Test", [], D1), ("s", "F", "Jo Test", ["jo@ex.test"], D1), ("s", "G", "Kay", [], D2), ("s", "H", "Kay", [], D1)],
        "site_id string, fingerprint string, canonical_name string, emails array<string>, last_seen_at timestamp",
    )
    people = spark.createDataFrame(
        [("s", D2, 0, "Ida Test", "ida@ex.test"), ("s", D2, 1, "Jo T.", "JO@ex.test "), ("s", D2, 2, "Jo Test", None), ("s", D2, 3, "New", "new@ex.test"),
         ("s", D2, 4, None, None), ("s", D2, 5, " KAY ", ""), ("t", D2, 6, "Ida Test", None)],
        "site_id string, snapshot_date timestamp, ord bigint, name string, email string",
    )
    rows = identity.resolve_identity(people, known).withColumn("h", F.md5(F.lower(F.coalesce("email", "name")))).collect()
    got = {r.ord: r for r in rows}
    assert got[0].fingerprint == "md5-name" and got[1].fingerprint == "F" and got[5].fingerprint == "G"
    assert got[2].fingerprint == got[2].h and got[3].fingerprint == got[3].h and got[6].fingerprint == got[6].h
    again = {r.ord: r.fingerprint for r in identity.resolve_identity(people, known).collect()}
    assert again[4] == got[4].fingerprint


def test_profiles(spark):
    df = members_df(spark, [
        member("s", D1, 0, "Ann", "Coach", category="A", fingerprint="f"), member("s", D2, 0, "Ann", "Dean", ["a@ex.test"], category="B", fingerprint="f"),
        member("s", D2, 1, "Ann", "Dean 2", ["a@ex.test"], category="C", fingerprint="f"),
    ])
    first = identity.profiles_from(df.where(F.col("snapshot_date") == D1))
    row = identity.upsert_profiles(first, df.where(F.col("snapshot_date") == D2)).first()
    assert (row.title, row.first_seen_at, row.last_seen_at, row.categories) == ("Dean 2", D1, D2, ["B", "C"])


def test_nesting_round_trip(spark):
    rows = [member("s", D1, i, f"P{i}", category=["A", "B", None][i % 3]) for i in range(10)]
    df = members_df(spark, rows)
    sections = nesting.nest(df, section_size=2).cache()
    assert {(r.category, r["count"], r.cat_ord) for r in sections.collect()} == {("A", 4, 0), ("B", 3, 1), ("default", 3, 2)}
    back = nesting.unnest_sections(sections)
    assert {(r.ord, r.name) for r in back.collect()} == {(i, f"P{i}") for i in range(10)}
    nested = spark.createDataFrame(
        [("s", D1, "r", "h", 3, [("A", 2, [("f0", "P0", None, [], [], None, None, None), ("f1", "P1", None, [], [], None, None, None)]), ("B", 1, [("f2", "P2", None, [], [], None, None, None)])])],
        NESTED_SNAPSHOTS,
    )
    assert [(r.ord, r.name, r.category) for r in nesting.unnest(nested).orderBy("ord").collect()] == [(0, "P0", "A"), (1, "P1", "A"), (2, "P2", "B")]


def test_parallel_lists_and_links(spark):
    df = spark.createDataFrame([(1, ["Ann", "Ben", ""], ["Coach"], ["a@ex.test", None, "c@ex.test"])], "id int, n array<string>, t array<string>, e array<string>")
    rows = nesting.zip_parallel(df, ["id"], "n", title="t", email="e").orderBy("place").collect()
    assert [(r.name, r.title, r.email) for r in rows] == [("Ann", "Coach", "a@ex.test"), ("Ben", None, None)]
    links = spark.createDataFrame([([("facebook", " /f "), ("other", ""), ("facebook", "/g")],)], "l array<struct<platform:string,link:string>>")
    assert links.select(nesting.link_map(F.col("l")).alias("m")).first().m == {"facebook": "/g"}
