"""The ordered rules against their sequential restatement, on random and on skewed data."""

import random

import numpy as np
import pytest
from helpers import D1, D2, links_in_order, member, members_df, people_in_order, score

from rosterlens.operators import linking, similar
from rosterlens.operators.compare import PAIR, _role, compare_fuzzy, name_links, sure_links
from rosterlens.operators.flatten import assign_leaders, flatten_people
from rosterlens.operators.similar import similar_names
from rosterlens.operators.snapshots import adjacent_pairs, snapshot_dates

FIRST = ["Ann", "Anna", "Anne", "Johnathan", "Jonathan", "Maria", "Mariana"]
LAST = ["Example", "Exampel", "Sample", "Samples", "Testperson", "Testpersons"]


def random_rows(rng, n, site, date):
    rows = []
    for i in range(n):
        name = rng.choice([None, "", "Vacant"] + [f"{rng.choice(FIRST)} {rng.choice(LAST)}" for _ in range(6)])
        title = rng.choice([None, "", "Coach", "Head Coach", "Director"])
        email = rng.choice([None, None] + [f"p{k}@ex.test" for k in range(n // 2 + 1)])
        url = rng.choice([None, None, None] + [f"/p/{k}" for k in range(n)]) if rng.random() < 0.5 else None
        if url and rng.random() < 0.3:
            url += "/"
        rows.append(dict(site=site, date=date, ord=i, name=name, title=title, email=email, url=url, category=rng.choice(["A", "a ", "B", "C"])))
    return rows


def to_df(spark, rows):
    return members_df(
        spark,
        [
            member(r["site"], r["date"], r["ord"], r["name"], r["title"], [r["email"]] if r["email"] else [], [], r["category"], r["url"], fingerprint=f"{r['site']}-{r['ord']}")
            for r in rows
        ],
    )


def random_sites(seed, sites, low=1, high=14):
    rng = random.Random(seed)
    return [r for s in range(sites) for d in (D1, D2) for r in random_rows(rng, rng.randint(low, high), f"s{s}", d)]


def split(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r["site"], r["date"]), []).append(r)
    return groups


@pytest.fixture(scope="module")
def random_data(spark):
    rows = random_sites(7, 120)
    return rows, to_df(spark, rows).cache()


def test_flatten_matches_sequential_rule(random_data):
    rows, df = random_data
    expected = {
        (*key, p["ord"], p["name"], p["title"], tuple(p["categories"])) for key, part in split(rows).items() for p in people_in_order(part)
    }
    got = {(r.site_id, r.snapshot_date, r.ord, r.name, r.title, tuple(r.categories)) for r in flatten_people(df).collect()}
    assert got == expected


def test_links_match_sequential_rule(spark, random_data):
    rows, df = random_data
    parts = {k: people_in_order(v) for k, v in split(rows).items()}
    expected = {(s, b, a) for s, d in parts if d == D1 for b, a in links_in_order(parts[s, D1], parts[s, D2])}
    people = flatten_people(df).cache()
    pairs = adjacent_pairs(snapshot_dates(df))
    before, after = _role(people, pairs, "before"), _role(people, pairs, "after")
    sure = sure_links(before, after).cache()
    rest_b = before.join(sure.withColumnRenamed("b", "ord"), [*PAIR, "ord"], "left_anti")
    rest_a = after.join(sure.withColumnRenamed("a", "ord"), [*PAIR, "ord"], "left_anti")
    got = {(r.site_id, r.b, r.a) for r in sure.unionByName(name_links(rest_b, rest_a)).collect()}
    assert got == expected


def test_rounds_alone_match_sequential_rule(spark, monkeypatch):
    """Without the per-group finish, rounds give the same links, also with long queues of one name."""
    rng = random.Random(3)
    names = ["Jon Sampleson", "Jan Sampleson", "Jen Sampleson", "Vacant Position", "Vacant Positions", "Ida Test"]
    before = [dict(ord=i, name=rng.choice(names), email=None, url=None) for i in range(40)]
    after = [dict(ord=i, name=rng.choice(names), email=None, url=None) for i in range(45)]
    b = spark.createDataFrame([("g", p["name"].lower(), p["ord"]) for p in before], "g string, v string, b bigint")
    a = spark.createDataFrame([("g", p["name"].lower(), p["ord"]) for p in after], "g string, w string, a bigint")
    monkeypatch.setattr(linking, "SMALL_GROUP_ROWS", 0)
    got = {(r.b, r.a) for r in linking.link_in_order(similar_names(b, a, ["g"]), b, a, ["g"]).collect()}
    assert got == links_in_order(before, after)


def test_one_hot_name_is_linked_in_one_round(spark, monkeypatch):
    b = spark.range(3000).selectExpr("'g' as g", "'vacant' as v", "id * 2 as b")
    a = spark.range(2000).selectExpr("'g' as g", "'vacant' as w", "id * 3 as a")
    monkeypatch.setattr(linking, "_finish_small", lambda *_: pytest.fail("must settle in rounds"))
    links = linking.link_in_order(similar_names(b, a, ["g"]), b, a, ["g"])
    assert links.count() == 2000
    assert links.where("b / 2 <> a / 3").count() == 0


@pytest.mark.parametrize("busy", [0, 10**9])
def test_similar_names_are_complete(spark, busy):
    """Pieces alone and deletion variants alone both find exactly the pairs above the threshold."""
    rng = random.Random(11)

    def word(n):
        return "".join(rng.choice("abc ") for _ in range(n)).strip().lower()

    def typo(w):
        for _ in range(rng.randint(0, 5)):
            i = rng.randint(0, len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abc") + w[i:], w[:i] + "x" + w[i + 1 :]])
        return w.strip()

    left = [word(rng.randint(1, 32)) for _ in range(60)]
    right = [typo(w) for w in left for _ in range(4)]
    lf = spark.createDataFrame([("g", w) for w in left], "g string, v string")
    rf = spark.createDataFrame([("g", w) for w in right], "g string, w string")
    expected = {(v, w) for v in left for w in right if v and w and score(v, w) > 0.85}
    got = {(r.v, r.w) for r in similar_names(lf, rf, ["g"], busy_piece_pairs=busy).where("v <> '' and w <> ''").collect()}
    assert got == expected


def test_long_chains_of_shared_keys(spark):
    """m1-m2-m3-... each sharing a key with the next: every second one leads."""
    rows = [dict(site="s", date=D1, ord=i, name=f"Person {i}", title="x", email=f"e{(i + 1) // 2}@ex.test", url=f"/u/{i // 2}", category="A") for i in range(41)]
    got = {r.ord: r.leader for r in assign_leaders(to_df(spark, rows)).collect()}
    people = [p["ord"] for p in people_in_order(rows)]
    assert sorted({v for v in got.values()}) == people


def test_invariants(random_data):
    _, df = random_data
    people = flatten_people(df)
    entries = compare_fuzzy(df).cache()
    counts = {(r.snapshot_date, ): r["count"] for r in people.groupBy("snapshot_date").count().collect()}
    added, removed = (entries.where(f"kind = '{k}'").count() for k in ("added", "removed"))
    assert counts[(D2,)] - added == counts[(D1,)] - removed
    assert entries.select("site_id", "kind", "ord").distinct().count() == entries.count()


def test_chains_of_contended_names_end_in_few_choices(spark, monkeypatch):
    """Rivals that displace each other over a whole group: few rounds of choices, not one round for each rival."""
    before = [dict(ord=2 * i, name=f"Person Nr 00{i:03d}", email=None, url=None) for i in range(0, 240, 3)]
    after = [dict(ord=2 * i + 1, name=f"Person Nr 00{i:03d}", email=None, url=None) for i in range(1, 240, 3)]
    b = spark.createDataFrame([("g", p["name"].lower(), p["ord"]) for p in before], "g string, v string, b bigint")
    a = spark.createDataFrame([("g", p["name"].lower(), p["ord"]) for p in after], "g string, w string, a bigint")
    monkeypatch.setattr(linking, "SMALL_GROUP_ROWS", 0)
    rounds = []
    for step in ("_choose", "_settle_round"):
        plain = getattr(linking, step)
        monkeypatch.setattr(linking, step, lambda *args, plain=plain: rounds.append(1) or plain(*args))
    got = {(r.b, r.a) for r in linking.link_in_order(similar_names(b, a, ["g"]), b, a, ["g"]).collect()}
    assert got == links_in_order(before, after)
    assert len(rounds) < 15


def test_choices_of_long_queues_that_interleave(spark, monkeypatch):
    rng = random.Random(11)
    names = ["Vacant Position", "Vacant Positions", "Vacant Positio", "Vacent Position"]
    before = [dict(ord=i, name=rng.choice(names), email=None, url=None) for i in range(90)]
    after = [dict(ord=i, name=rng.choice(names[:3]), email=None, url=None) for i in range(70)]
    b = spark.createDataFrame([("g", p["name"].lower(), p["ord"]) for p in before], "g string, v string, b bigint")
    a = spark.createDataFrame([("g", p["name"].lower(), p["ord"]) for p in after], "g string, w string, a bigint")
    monkeypatch.setattr(linking, "SMALL_GROUP_ROWS", 0)
    got = {(r.b, r.a) for r in linking.link_in_order(similar_names(b, a, ["g"]), b, a, ["g"]).collect()}
    assert got == links_in_order(before, after)


def test_names_of_one_length_meet_by_the_pieces_of_that_length(spark):
    """Names of 12 letters may differ in one: two pieces of six letters, not three of four as for a partner of 14."""
    lv = spark.createDataFrame([("g", "abcdefghijkl", 12)], "g string, v string, v_len int")
    rw = spark.createDataFrame([("g", "abcdxxxxxxxx", 12), ("g", "abcdefghijkx", 12)], "g string, w string, w_len int")
    at = ["g", "w_len", "edits", "piece_no", "piece"]
    met = similar._left_pieces(lv, ["g"], 0.85).join(similar._right_pieces(rw, ["g"], 0.85), at)
    assert [r.w for r in met.collect()] == ["abcdefghijkx"]


def test_running_numbers_are_linked_in_one_pass(spark, monkeypatch):
    """Names that nearly all resemble each other: no round over their edges, and the common ends of the names are not compared."""
    rng = random.Random(5)
    before = [dict(ord=2 * i, name=f"Customer#{n:09d} jr", email=None, url=None) for i, n in enumerate(rng.sample(range(2000), 120))]
    after = [dict(ord=2 * i + 1, name=f"Customer#{n:09d} jr", email=None, url=None) for i, n in enumerate(rng.sample(range(2000), 110))]
    columns = ["site_id string, from_date int, to_date int, name string, ord bigint"]
    b, a = (spark.createDataFrame([("s", 1, 2, p["name"], p["ord"]) for p in side], *columns) for side in (before, after))
    for step in ("_settle_round", "_settle_by_choices"):
        monkeypatch.setattr(linking, step, lambda *_: pytest.fail("must be finished at once"))
    monkeypatch.setattr(similar, "BUSY_PIECE_PAIRS", 10)
    assert {(r.b, r.a) for r in name_links(b, a).collect()} == links_in_order(before, after)


def test_skeletons_are_shared_within_the_edits_only(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("01") for _ in range(n)) for n in (5, 6, 7, 8) for _ in range(12)})
    # Ten letters that all share come before: the names are 15 to 18 long and may differ in two letters.
    texts = spark.createDataFrame([(w, len(w) + 10) for w in words], "t string, n int")
    found = [similar._skeletons(texts.t, texts.n, [15, 16, 17, 18], 0.85, left) for left in (True, False)]
    bones = {r.t: (set(r.v), set(r.w)) for r in texts.select("t", found[0].alias("v"), found[1].alias("w")).collect()}
    for v in words:
        for w in words:
            if v != w:
                near = score("x" * 10 + v, "x" * 10 + w) > 0.85
                assert near == bool(bones[v][0] & bones[w][1]), (v, w)


def test_common_ends_count_in_the_length_only(spark):
    """Names within the group's common ends, shorter than them, equal to them, and of neighbouring lengths."""
    names = ["aaaaaaaabbbbbbbb", "aaaaaaaacbbbbbbbb", "aaaaaaaabbbbbbb", "aaaaaaaaccbbbbbbbb", "aaaaaaaabcbbbbbbbb", "aaaaaaaa1234bbbbbbb"]
    lf = spark.createDataFrame([("g", w) for w in names[::2]] + [("h", w) for w in names], "g string, v string")
    rf = spark.createDataFrame([("g", w) for w in names[1::2]] + [("h", w) for w in names], "g string, w string")
    expected = {("g", v, w) for v in names[::2] for w in names[1::2] if score(v, w) > 0.85}
    expected |= {("h", v, w) for v in names for w in names if score(v, w) > 0.85}
    found = similar_names(lf, rf, ["g"], busy_piece_pairs=0).collect()
    assert {(r.g, r.v, r.w) for r in found} == expected
    assert len(found) == len(expected)
    assert all(abs(r.score - score(r.v, r.w)) < 1e-12 for r in found)


def test_rule_on_numbers_matches_the_queues_of_names():
    """The pass over arrays takes the best score, then the lowest open place, also where queues move on at different speeds."""
    rng = random.Random(9)
    for _ in range(200):
        names = [rng.choice("ab") + rng.choice("cd") + "Sampleson" + rng.choice(["", "x"]) for _ in range(6)]
        before, after = ([dict(ord=i, name=rng.choice(names), email=None, url=None) for i in rng.sample(range(99), rng.randint(1, 14))] for _ in "ba")
        code = {name: i for i, name in enumerate(sorted(set(names)))}
        edges = [(code[v], code[w], score(v, w)) for v in code for w in code if score(v, w) > 0.85]
        rng.shuffle(edges)
        column = lambda rows, i, kind="int64": np.array([r[i] for r in rows], dtype=kind)
        sides = [[(code[p["name"]], p["ord"]) for p in side] for side in (before, after)]
        b, a = linking._rule((column(edges, 0), column(edges, 1), column(edges, 2, "float64")), *[(column(s, 0), column(s, 1)) for s in sides])
        ordered = [sorted(side, key=lambda p: p["ord"]) for side in (before, after)]
        assert set(zip(b.tolist(), a.tolist())) == links_in_order(*ordered)
