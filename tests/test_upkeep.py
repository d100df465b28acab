"""Upkeep, registry, search and export rules that the SQL comparison does not reach."""

import datetime as dt

import pytest
from helpers import D1, D2, D3, member, members_df

from pyspark.sql import functions as F

from rosterlens.operators import ordered, registry, upkeep
from rosterlens.plans import dashboard, export, search
from rosterlens.schemas import CHANGE_LOG, DIRECTORIES, ENTRIES, FAILED, SITES
from rosterlens.sources import tables


def directory(page, base="https://b.test", ipeds="", school="", rule=None, failed=False, at=None, active=True):
    return (base, page, ipeds, school, rule, failed, at, 1, 5, active)


def test_rollback_and_pointers(spark):
    may = dt.datetime(2026, 5, 10)
    edge = dt.datetime(2026, 5, 1, 3, 30)  # still April in New York
    members = members_df(spark, [member("s", d, 0, "Ann") for d in (D1, edge, may)] + [member("t", may, 0, "Ben")])
    sites = spark.createDataFrame([("s", "u", "p", may, "x", D1), ("t", "v", "q", may, "y", D1)], SITES)
    log = spark.createDataFrame([("1", "s", edge, may, may, 0, 0, 1), ("2", "s", D1, edge, edge, 0, 0, 1)], CHANGE_LOG)
    profiles = spark.createDataFrame([("s", "f", edge), ("t", "g", may)], "site_id string, fingerprint string, first_seen_at timestamp")
    dirs = spark.createDataFrame([directory("p", at=may), directory("q", at=may, active=False), directory("r", at=edge)], DIRECTORIES)
    tables_ = dict(members=members, sites=sites, change_log=log, profiles=profiles, directories=dirs)
    new = upkeep.rollback_month(tables_, 2026, 5, dt.datetime(2026, 4, 1, 12))
    assert new["members"].count() == 2 and [r.change_id for r in new["change_log"].collect()] == ["2"]
    assert [r.fingerprint for r in new["profiles"].collect()] == ["f"]
    assert {r.staff_directory: r.last_processed_at for r in new["directories"].collect()} == {"p": dt.datetime(2026, 4, 1, 12), "q": may, "r": edge}
    got = {r.site_id: (r.latest_snapshot_id, r.last_scraped_at) for r in new["sites"].collect()}
    assert got == {"s": ("s@2026-05-01T03:30:00", edge), "t": (None, None)}


def test_reset_and_delete_by_rule(spark):
    sites = spark.createDataFrame([("s", "u", "p", D1, "x", D1), ("t", "v", "q", D1, "y", D1)], SITES)
    dirs = spark.createDataFrame([directory("p", "other", rule="r1", failed=True), directory("q", "v", rule="r2"), directory("z", "u", rule="r1")], DIRECTORIES)
    members = members_df(spark, [member("s", D1, 0, "Ann"), member("t", D1, 0, "Ben")])
    failed = spark.createDataFrame([("p", "u", "no_data", "", "", D1, 1), ("q", "v", "no_data", "", "", D1, 1)], FAILED)
    state = dict(sites=sites, directories=dirs, members=members, failed=failed)
    new = upkeep.reset_sites(state, sites.where("site_id = 's'"))
    assert [r.site_id for r in new["members"].collect()] == ["t"] and [r.staff_directory for r in new["failed"].collect()] == ["q"]
    assert {r.staff_directory: (r.successful_rule, r.rule_failed_last_time) for r in new["directories"].collect()} == {"p": (None, False), "q": ("r2", False), "z": (None, False)}
    assert {r.site_id: r.latest_snapshot_id for r in new["sites"].collect()} == {"s": None, "t": "y"}
    with pytest.raises(ValueError):
        upkeep.delete_by_rule(state, "r1", expected=1)
    new = upkeep.delete_by_rule(state, "r1", expected=2)
    assert [r.staff_directory for r in new["directories"].collect()] == ["q"] and [r.site_id for r in new["sites"].collect()] == ["t"]


def test_failure_success_clears(spark):
    none = spark.createDataFrame([("old", "b", "no_data", "e", "h", D1, 4), ("ok", "b", "no_data", "e", "h", D1, 2)], FAILED)
    out = spark.createDataFrame(
        [("old", "b", D2, False, "fetch_failed", "x" * 600, "y" * 6000), ("ok", "b", D2, True, None, None, None), ("ok", "b", D3, False, "no_data", "again", None)],
        "staff_directory string, base_url string, at timestamp, success boolean, failure_type string, error_message string, html string",
    )
    got = {r.staff_directory: r for r in upkeep.update_failures(none, out).collect()}
    assert (got["old"].attempt_count, got["old"].failure_type, len(got["old"].error_message), len(got["old"].html_excerpt)) == (5, "fetch_failed", 500, 5000)
    assert (got["ok"].attempt_count, got["ok"].error_message) == (1, "again")
    snippet = {r.staff_directory: r.html_snippet for r in upkeep.list_failures(upkeep.update_failures(none, out)).collect()}
    assert snippet["old"] == "y" * 200 + "..." and snippet["ok"] is None


def test_due_list_is_local(spark):
    now = dt.datetime(2026, 5, 1, 3, 30)  # April in New York
    dirs = spark.createDataFrame(
        [directory("april", at=dt.datetime(2026, 4, 2)), directory("march", at=dt.datetime(2026, 4, 1, 3)), directory("never", rule="r"), directory("off", active=False)], DIRECTORIES
    )
    assert [r.staff_directory for r in registry.due_list(dirs, now).collect()] == ["never", "march"]


def test_registry_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"baseUrl": "b.test", "staffDirectory": "//b.test/staff", "ipeds": "1"}, {"baseUrl": "c.test", "staffDirectory": "c.test/staff"}]')
    (tmp_path / "b.json").write_text('[{"baseUrl": "https://d.test", "staffDirectory": "https://d.test/www.e.test/s", "schoolName": "D"}]')
    rows = registry.fix_doubled_urls(registry.fix_protocols(registry.read_registry_json(spark, str(tmp_path / "*.json"))))
    assert {(r.base_url, r.staff_directory) for r in rows.collect()} == {
        ("https://b.test", "https://b.test/staff"), ("https://c.test", "https://c.test/staff"), ("https://d.test", "https:///www.e.test/s"),
    }
    (tmp_path / "s.csv").write_text("IPEDS,School,Athletics,College,Code,Staff\n1, North ,a.test,n.test,X,a.test/staff\n2,,b.test,m.test,Y,\n")
    got = registry.read_registry_sheet(spark, str(tmp_path / "s.csv")).collect()
    assert [(r.school_name, r.base_url) for r in got] == [("North", "n.test")]


def test_search_options(spark):
    df = members_df(spark, [
        member("s", D1, 0, "Ann (Golf)", "Coach", ["Ann@ex.test"], ["(555) 010-0199"], "Golf", fingerprint="a"),
        member("s", D1, 1, "Ben", None, [], [], "Pool", fingerprint="b"), member("t", D2, 0, "Ann (Golf)", "Dean", [], [], "Pool", fingerprint="a"),
    ])
    sites = spark.createDataFrame([("s", "https://s.test", "p", None, None, None), ("t", "https://t.test", "q", None, None, None)], SITES)

    def names(**kw):
        return sorted(r.fingerprint for r in search.search_people(df, sites, **kw).collect())

    assert names(name="(golf)") == ["a"] and names(name="^ben$") == [] and names(name="^ben$", regex=True) == ["b"]
    assert names(phone="5550100199") == ["a"] and names(phone="(555) 010-0199", exact=True) == ["a"]
    assert names(email="ann@ex.test", exact=True) == [] and names(email="ANN@") == ["a"]
    assert names(category="golf") == ["a", "b"] and names(category="golf", category_scope="member") == ["a"]
    assert names(site="t.test") == ["a"] and names(site="nowhere") == []
    row = search.search_people(df, sites, name="ann").first()
    assert (row.title, row.first_seen, row.latest_seen, len(row.sites)) == ("Dean", D1, D2, 2)
    page = search.search_page(df, sites, page=2, limit=1)
    assert (page.total, page.total_pages, page.has_next, page.has_prev, [r.fingerprint for r in page.rows.collect()]) == (2, 2, False, True, ["b"])
    assert [r.value for r in search.suggest(df, "x.t", "email").collect()] == ["Ann@ex.test"] and search.suggest(df, "a").count() == 0


def test_empty_export_and_summary(spark, tmp_path):
    none_e, none_l = spark.createDataFrame([], ENTRIES), spark.createDataFrame([], CHANGE_LOG)
    summary = {r.metric: r.value for r in export.export_summary(none_e, none_l, spark.createDataFrame([], "site_id string")).collect()}
    assert set(summary.values()) == {0} and len(summary) == 5
    assert dashboard.site_statistics(none_l, "s").first().asDict() == {"changes": 0, "added_total": 0, "removed_total": 0, "updated_total": 0}
    docs = spark.createDataFrame([(["a"], None, []), (None, ["b", "c"], None)], "added array<string>, removed array<string>, updated array<string>")
    assert dashboard.array_totals(docs).first().asDict() == {"changes": 2, "added_total": 1, "removed_total": 2, "updated_total": 0}


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "site_id string, n int")
    tables.write_by_site(df, path)
    tables.write_by_site(tables.read_table(spark, path).where("site_id = 'a'").withColumn("n", F.col("n") + 10), path)
    assert {(r.site_id, r.n) for r in tables.read_table(spark, path).collect()} == {("a", 11), ("b", 2)}
    with pytest.raises(ValueError):
        tables.assert_unique(df.union(df), ["site_id"], "t")
    with pytest.raises(ValueError):
        tables.assert_values(df, "site_id", ["a"])


def test_ordered_operators_across_ranges(spark):
    rows = [("k", i * 3) for i in range(50)] + [("m", 7)]
    df = spark.createDataFrame(rows, "k string, o bigint")
    ranks = ordered.grouped_rank(df, ["k"], "o", ranges=9).where("k = 'k' and rank <> o / 3 + 1").count()
    assert ranks == 0
    carried = ordered.carry_last(df, ["k"], "o", F.when(F.col("o") % 30 == 0, F.col("o")), "head", ranges=7)
    assert carried.where("k = 'k' and head <> floor(o / 30) * 30").count() == 0
    assert carried.where("k = 'm' and head is null").count() == 1


def test_smallest_cover(spark):
    import random

    rng = random.Random(5)
    spans = [(rng.choice("xyz"), lo, lo + rng.randint(0, 60), rng.randint(0, 99)) for lo in (rng.randint(-1, 120) for _ in range(80))] + [("w", 5, 2**62, 1)]
    points = [(k, o) for k in "wxyzq" for o in range(0, 150, 3)]
    got = {(r.k, r.ord): r.owner for r in ordered.smallest_cover(
        spark.createDataFrame(points, "k string, ord bigint"), spark.createDataFrame(spans, "k string, low bigint, high bigint, owner bigint"), ["k"]).collect()}
    want = {}
    for k, o in points:
        around = [w for kk, lo, hi, w in spans if kk == k and lo < o <= hi]
        if around:
            want[k, o] = min(around)
    assert got == want


def test_contacts_fall_back_to_the_open_object(spark):
    """Listed values first, then raw's single value, then its list; raw as a map of texts or as a VARIANT."""
    rows = [(["a@x"], '{"email": "no@x"}'), ([], '{"email": "one@x", "emails": ["no@x"]}'), ([], '{"email": "", "emails": ["two@x", "no@x"]}'), (None, None), ([], "{}")]
    df = spark.createDataFrame(rows, "emails array<string>, j string")
    variant = df.withColumn("raw", F.parse_json("j"))
    texts = df.withColumn("raw", F.from_json("j", "map<string,string>"))
    want = ["a@x", "one@x", "two@x", "", ""]
    for table in (variant, texts):
        assert [r[0] for r in table.select(export.contact(table, "email")).collect()] == want
    assert [r[0] for r in df.select(export.contact(df, "email")).collect()] == ["a@x", "", "", "", ""]
