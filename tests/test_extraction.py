"""One synthetic page per layout family."""

import datetime as dt
import random
from itertools import product

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterlens.operators import extraction as x
from rosterlens.operators import table_roles
from rosterlens.plans.ingest import ingest
from rosterlens.schemas import DIRECTORIES, PAGES, PROFILES, SITES, empty
from rosterlens.sources import elements

MAIL = '<a href="mailto:{0}@ex.test?subject=hi">mail</a>'
PAGE = {
    "table": "<table><tr><th>Name</th></tr><tr><td>Dr. Ann  Example</td><td>Head Coach</td><td>" + MAIL.format("ann") + '</td><td><a href="tel:(555) 010-0001">x</a></td></tr>'
             "<tr><td>- Vacant -</td><td>Coach</td></tr><tr><td>Dr. Ann Example<td>Head Coach<td>" + MAIL.format("ann") + '<td><a href="tel:5550100001">y</a></table>',
    "grouped": '<table class="staff"><tr class="head"><td colspan=3>Office</td></tr><tr><td>Ann</td><td>Dean</td><td>ann@ex.test</td></tr>'
               '<tr class="head"><td colspan=3>Pool</td></tr><tr><td>Ben</td><td>Guard</td><td>ben@ex.test</td></tr></table>',
    "sections": "<h2>Office</h2><table><tr><td>Ann A</td><td>Dean</td><td>555-010-0001</td></tr></table><h2>Pool</h2><table><tr><td>Ben B</td><td>Guard</td><td>5550100002</td></tr></table>",
    "cards": '<h3 class="sport">Golf</h3><div class="card"><a class="who" href="/p/ann">Ann A</a><span class="job">Coach &amp; Dean</span>' + MAIL.format("ann")
             + '<script>var full_email = "zz@ex.test"</script></div><div class="card"><div><a class="who" href="/p/ben">Ben B</a></div><a href="tel:5550100002">call</a></div>',
    "microdata": '<div itemtype="https://schema.org/Person"><h6 itemprop="name">Ann A</h6><p itemprop="jobTitle">Dean</p><a itemprop="email" href="mailto:ann@ex.test">m</a></div>',
    "data": '<table><tr data-name="Ann A" data-position="Dean" data-dept="Office" data-email="ann@ex.test"><td>x</td><td>555-010-0001</td></tr></table>',
    "text": "<div><p>Ann Example Head of Office, ann@ex.test, 555 010 0001</p><p>Short line</p></div>",
    "empty": "<p>Nobody here</p>",
}
IDS = {name: i for i, name in enumerate(PAGE)}
CARDS = x.card_rule("cards", "card", "who", "job", heading_cls="sport")
GROUPED = x.grouped_table_rule("grouped", "staff", x.Find(tag="tr", cls="head"), ["name", "title", "email"])


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"https://ex.test/{n}/list", PAGE[n], None) for n, i in IDS.items()]
    return spark.createDataFrame(rows + [(90, "https://ex.test/late/list", "<p></p>", PAGE["table"]), (91, "https://ex.test/none/list", None, None)], PAGES)


@pytest.fixture(scope="module")
def people(pages):
    rules = [CARDS, GROUPED, x.MICRODATA, x.DATA_ROWS, x.SECTION_TABLES, x.GENERIC_TABLE, x.FREE_TEXT]
    return x.extract_people(pages, rules).cache()


def rows_of(people, name):
    rows = people.where(f"page_id = {IDS.get(name, name)}").orderBy("ord").collect()
    return [(r.rule, r.name, r.title, r.email, r.phone, r.category) for r in rows]


def test_layouts(people):
    ann = ("Ann Example", "Head Coach", "ann@ex.test", "555-010-0001")
    assert rows_of(people, "table") == [("section_tables", *ann, None)]
    assert rows_of(people, "grouped") == [
        ("grouped", "Ann", "Dean", "ann@ex.test", None, "Office"), ("grouped", "Ben", "Guard", "ben@ex.test", None, "Pool"),
    ]
    assert rows_of(people, "sections") == [
        ("section_tables", "Ann A", "Dean", None, "555-010-0001", "Office"), ("section_tables", "Ben B", "Guard", None, "555-010-0002", "Pool"),
    ]
    assert rows_of(people, "cards") == [
        ("cards", "Ann A", "Coach & Dean", "ann@ex.test", None, "Golf"), ("cards", "Ben B", None, None, "555-010-0002", "Golf"),
    ]
    assert rows_of(people, "microdata") == [("microdata", "Ann A", "Dean", "ann@ex.test", None, "Staff Directory")]
    assert rows_of(people, "data") == [("data_rows", "Ann A", "Dean", "ann@ex.test", "555-010-0001", "Office")]
    assert rows_of(people, "text") == [("free_text", "Ann Example Head", "of Office, ann", "ann@ex.test", "555-010-0001", "Staff Directory")]
    assert rows_of(people, "empty") == []
    assert rows_of(people, 90) == [("section_tables", *ann, None)]
    links = {r.name: r.profile_url for r in people.where(f"page_id = {IDS['cards']}").collect()}
    assert links == {"Ann A": "https://ex.test/p/ann", "Ben B": "https://ex.test/p/ben"}


def test_outcomes(pages, people):
    got = {r.page_id: (r.outcome, r.staff_count) for r in x.page_outcomes(pages, people).collect()}
    assert got[IDS["empty"]] == ("no_data", 0) and got[91] == ("fetch_failed", 0) and got[90] == ("success", 1)


def test_remembered_rule_goes_first(spark, pages):
    known = spark.createDataFrame([(IDS["microdata"], "free"), (IDS["text"], "absent")], "page_id bigint, known_rule string")
    free = x.PythonRule("free", lambda html, url: [{"name": "From Function", "title": url}] if "itemprop" in html else None)
    got = x.extract_people(pages.where(f"page_id in ({IDS['microdata']}, {IDS['text']})"), [x.MICRODATA, x.FREE_TEXT, free], known)
    assert {(r.page_id, r.rule, r.name) for r in got.collect()} == {
        (IDS["microdata"], "free", "From Function"), (IDS["text"], "free_text", "Ann Example Head"),
    }


def test_ingest(spark, pages):
    registry = spark.createDataFrame([("https://ex.test", "https://ex.test/cards/list", "", "", "cards", False, None, 0, 0, True)], DIRECTORIES)
    now = dt.datetime(2026, 5, 1, 12)
    some = pages.where(f"page_id in ({IDS['cards']}, {IDS['empty']})")
    result = ingest(some, registry, empty(spark, SITES), empty(spark, PROFILES), now, [CARDS, x.GENERIC_TABLE])
    assert {(r.name, tuple(r.emails), r.category) for r in result.members.collect()} == {("Ann A", ("ann@ex.test",), "Golf"), ("Ben B", (), "Golf")}
    assert result.profiles.count() == 2 and result.snapshots.first().total_count == 2
    assert {(r.staff_directory, r.success, r.known_rule) for r in result.runs.collect()} == {
        ("https://ex.test/cards/list", True, "cards"), ("https://ex.test/empty/list", False, None),
    }
    assert [r.latest_snapshot_id is not None for r in result.sites.collect()] == [True]
    assert {(r.success, r.failure_type) for r in result.outcomes.collect()} == {(True, None), (False, "no_data")}


def test_columns_get_their_roles(spark):
    """Headers decide first, contents next; a column has one role; tables without names are no people."""
    head = "<tr><th>Room</th><th>Phone</th><th>Position</th><th>E-Mail</th><th>Full Name</th></tr>"
    line = "<tr><td>Ann Arbor</td><td>555-010-0001</td><td>Head Coach</td><td>ann@ex.test</td><td><a href='/p/1'>Ann Example</a></td></tr>"
    bare = "<tr><td>x1</td><td>ben@ex.test</td><td>Ben Sample</td><td>Dean</td></tr><tr><td></td><td>--</td><td>Cy Person</td><td>Dean</td></tr>"
    none = "<table><tr><td>1</td><td>2</td></tr></table><table><tr><td>Only Names</td></tr></table>"
    rows = [(1, "https://ex.test/a", f"<table>{head}{line}{line}</table>"), (2, "https://ex.test/b", f"<table>{bare}</table>{none}"), (3, "https://ex.test/c", none)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {tuple(r) for r in x.extract_people(pages, [table_roles.TableRoles()]).select("page_id", "name", "title", "email", "phone", "profile_url").collect()}
    assert got == {
        (1, "Ann Example", "Head Coach", "ann@ex.test", "555-010-0001", "https://ex.test/p/1"),
        (2, "Ben Sample", "Dean", "ben@ex.test", None, None), (2, "Cy Person", "Dean", None, None, None),
    }


def test_assignment_is_the_best_one_to_one(spark, monkeypatch):
    rng = random.Random(4)
    values = {t: [[rng.choice([0, 0, 1, 2, 3, 4]) for _ in range(4)] for _ in range(rng.randint(1, 6))] for t in range(60)}
    rows = [(1, t, c, *scores) for t, columns in values.items() for c, scores in enumerate(columns)]
    cells = spark.createDataFrame(rows, "page_id long, table_ord int, cell int, s0 int, s1 int, s2 int, s3 int")
    monkeypatch.setattr(table_roles, "_scores", lambda: {role: F.max(f"s{i}").cast("double") for i, role in enumerate(table_roles.ROLES)})
    want = {}
    for t, columns in values.items():
        picks = [p for p in product(range(-1, len(columns)), repeat=4) if len({c for c in p if c >= 0}) == sum(c >= 0 for c in p) and all(c < 0 or columns[c][i] > 0 for i, c in enumerate(p))]
        best = min(picks, key=lambda p: (-sum(columns[c][i] for i, c in enumerate(p) if c >= 0), p))
        if best[0] >= 0 and max(best[1:]) >= 0:
            want[t] = sum(columns[c][i] for i, c in enumerate(best) if c >= 0)
    got = {r.table_ord: [r[role] for role in table_roles.ROLES] for r in table_roles.column_roles(cells).collect()}
    for t, picks in got.items():
        assert len({c for c in picks if c >= 0}) == sum(c >= 0 for c in picks)
        assert sum(values[t][c][i] for i, c in enumerate(picks) if c >= 0) == max(
            sum(values[t][c][i] for i, c in enumerate(p) if c >= 0) for p in product(range(-1, len(values[t])), repeat=4) if len({c for c in p if c >= 0}) == sum(c >= 0 for c in p)
        )
    assert set(want) <= set(got)


def test_element_rows_leave_the_tokeniser_in_bounded_blocks(monkeypatch):
    """Blocks end by their letters as well as by their rows, whatever a page holds."""
    monkeypatch.setattr(elements, "LETTERS_PER_BATCH", 1000)
    page = "<ul>" + "".join(f"<li>{'x' * 90}{i}</li>" for i in range(60)) + "</ul>"
    batch = pa.RecordBatch.from_pylist([{"page_id": 1, "url": "u", "html": page}, {"page_id": None, "url": None, "html": "<a href='/b'>c</a>"}])
    blocks = list(elements._to_rows(iter([batch])))
    rows = [r for b in blocks for r in b.to_pylist()]
    assert [r["ord"] for r in rows] == [*range(61), 0]
    assert rows[-1] == {"page_id": None, "url": None, "ord": 0, "tag": "a", "id": None, "classes": [], "attrs": [("href", "/b")], "cell": None, "text": "c", "lineage": []}
    assert all(sum(len(r["text"]) for r in b.to_pylist()[:-1]) < 1000 for b in blocks)
