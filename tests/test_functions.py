"""Column functions, all checked in one pass each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rosterlens.functions import contacts, names, text, urls


def check(spark, cases):
    """cases: (label, Column, expected); evaluates all of them on one row."""
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (_, c, _) in enumerate(cases)]).first()
    wrong = [(label, row[i], want) for i, (label, _, want) in enumerate(cases) if row[i] != want]
    assert not wrong, wrong


def L(v):
    return F.lit(v)


def N():
    return F.lit(None).cast("string")


def arr(*v):
    return F.array(*[F.lit(x) for x in v]).cast("array<string>")


def test_text(spark):
    check(spark, [
        ("norm", text.norm(L("  Ann\tB 　")), "ann\tb"),
        ("collapse", text.collapse(L(" a \n  b ")), "a b"),
        ("email first mailto only", text.clean_email(L(" MAILTO:Ann@Ex.test ")), "ann@ex.test"),
        ("email empty", text.clean_email(L("mailto:")), None),
        ("url key drops one slash", text.url_key(L("http://x//")), "http://x/"),
        ("url key empty", text.url_key(L("")), None),
        ("similar at the limit is not above", text.similarity(L("abcdefghijklmnopqrst"), L("abcdefghijklmnopqxyz")), 0.85),
        ("similarity of missing", text.similarity(L(""), L("")), 0.0),
        ("similarity ignores case", text.similarity(L(" ANN "), L("ann")), 1.0),
        ("same text", text.same_text(L(" A "), L("a")), True),
        ("null equals null only", text.same_text(N(), L("")), False),
        ("same set", text.same_set(arr("B ", "a"), arr("A", "b")), True),
        ("set lengths differ", text.same_set(arr("a", "a"), arr("a")), False),
        ("distinct by norm", text.distinct_by_norm(arr("A", "a ", "B")), ["A", "B"]),
        ("strip tags", text.strip_tags(L("Head<br/>Coach <b>&amp;</b>&nbsp;Dean")), "Head - Coach & Dean"),
        ("local month", text.local_year_month(L("2026-05-01 03:30:00").cast("timestamp")), dt.date(2026, 4, 1)),
        ("in month", text.in_local_month(L("2026-05-01 04:30:00").cast("timestamp"), 2026, 5), True),
        ("no date is in no month", text.in_local_month(L(None).cast("timestamp"), 2026, 5), False),
        ("structure", text.same_structure(F.struct(L(1).alias("a")), F.struct(L(1).alias("a"))), True),
        ("list", text.show_list(arr("a", "b")), "a, b"),
        ("empty list", text.show_list(arr(), "-"), "-"),
    ])


def test_names(spark):
    position = names.change_position
    check(spark, [
        ("first", names.first_name(L("  Ann  B C")), "Ann"),
        ("last keeps inner spaces", names.last_name(L("Ann  B C")), " B C"),
        ("one word", names.last_name(L("Ann")), ""),
        ("honorific", names.strip_honorific(L("dr. Ann B")), "Ann B"),
        ("host", names.school_from_url(L("https://www.north-hill.ex.edu/staff")), "North-hill Ex University"),
        ("host with college", names.school_from_url(L("http://OneCollege.edu")), "Onecollege"),
        ("no scheme", names.school_from_url(L("www.north.hill.edu/x")), "North Hill.Edu"),
        ("missing", names.school_from_url(N()), "Unknown School"),
        ("slug", names.slug(L("A b&C")), "a-b-c"),
        ("position word", names.is_name_like(L("Head Of Sports"), L("x")), False),
        ("equal to the person", names.is_name_like(L("Ann B. Example"), L("Ann B. Example")), True),
        ("single token", names.is_name_like(L("Ann"), N()), True),
        ("capital words", names.is_name_like(L("Ann Example"), N()), True),
        ("linking word", names.is_name_like(L("Dean Of Students"), N()), False),
        ("mixed", names.is_name_like(L("ann example"), N()), False),
        ("full export", names.full_export_position(L(""), N()), "(General Contact)"),
        ("school export skips names", names.school_export_position(L("Ann"), L("Head Coach"), L("Ann")), "Head Coach"),
        ("job change shows", position(L("Ann"), L("Ann"), L("ja")), "Ann"),
        ("job change cleared", position(N(), L("Ann"), L("j")), "(Position removed/cleared)"),
        ("plain coach", position(L("Coach"), L("Ann"), N()), ""),
        ("coach without person", position(L("Coach"), L(""), N()), "Coach"),
        ("only the name", position(L(" Ann B "), L("Ann B"), L("a")), ""),
        ("more than the name", position(L("Ann B, Dean"), L("Ann B"), L("a")), "Ann B, Dean"),
    ])


def test_contacts(spark):
    line = "Ann Example Head Coach, ann@ex.test 555-010-0001"
    check(spark, [
        ("email", contacts.find_email(L(line)), "ann@ex.test"),
        ("phone", contacts.find_phone(L(line)), "555-010-0001"),
        ("label", contacts.find_labelled_phone(L("x Phone: (555) 010-0001 y")), "(555) 010-0001"),
        ("lead name", contacts.leading_name(L("Ann Example head")), "Ann Example"),
        ("three words", contacts.leading_name(L("Ann Mary Example x")), "Ann Mary Example"),
        ("title", contacts.title_between(L("Ann Example - head of office: 555 010 0001"), L("Ann Example")), "head of office"),
        ("dashed", contacts.dashed_phone(L("(555) 010.0001")), "555-010-0001"),
        ("dashed other length", contacts.dashed_phone(L("010-0001")), "0100001"),
        ("plus", contacts.plus_dashed_phone(L("+1 555 010 0001")), "+1-555-010-0001"),
        ("plus keeps", contacts.plus_dashed_phone(L("ext 5")), "ext 5"),
        ("bracketed", contacts.bracketed_phone(L("5550100001")), "(555) 010-0001"),
        ("country", contacts.bracketed_phone(L("1-555-010-0001")), "+1 (555) 010-0001"),
        ("extension", contacts.with_extension(L("555"), L("Ext. 12")), "555 ext. 12"),
        ("no extension", contacts.with_extension(L("555"), L("none")), "555"),
        ("mailto drops query", contacts.mailto_address(L("mailto:a@ex.test?subject=x")), "a@ex.test"),
        ("tel", contacts.tel_number(L("tel:555 ")), "555"),
        ("script", contacts.script_email(L("var firstHalf = 'a'; var secondHalf = \"ex.test\";")), "a@ex.test"),
        ("script whole", contacts.script_email(L("var full_email = 'b@ex.test'")), "b@ex.test"),
        ("placeholder", contacts.drop_placeholder(L(" - Vacant - ")), None),
        ("challenge", contacts.is_challenge_page(L("<p>Just A Moment</p>")), True),
        ("normal page", contacts.is_challenge_page(L("<p>staff</p>")), False),
        ("no page", contacts.is_challenge_page(N()), False),
    ])


def test_urls(spark):
    page = L("https://ex.test/staff/list?x=1#top")
    check(spark, [
        ("bare", urls.ensure_protocol(L(" ex.test ")), "https://ex.test"),
        ("relative scheme", urls.ensure_protocol(L("//ex.test")), "https://ex.test"),
        ("kept", urls.ensure_protocol(L("http://ex.test")), "http://ex.test"),
        ("empty", urls.ensure_protocol(L("")), ""),
        ("doubled", urls.repair_doubled(L("https://ex.test"), L("https://ex.test/www.other.test/staff")), "https:///www.other.test/staff"),
        ("not doubled", urls.repair_doubled(L("https://ex.test"), L("https://ex.test/staff")), "https://ex.test/staff"),
        ("absolute", urls.resolve_link(L("http://o.test/a"), page), "http://o.test/a"),
        ("root", urls.resolve_link(L("/a"), page), "https://ex.test/a"),
        ("scheme", urls.resolve_link(L("//o.test/a"), page), "https://o.test/a"),
        ("sibling", urls.resolve_link(L("b"), page), "https://ex.test/staff/b"),
        ("query", urls.resolve_link(L("?p=2"), page), "https://ex.test/staff/list?p=2"),
        ("from host", urls.resolve_link(L("b"), L("https://ex.test")), "https://ex.test/b"),
        ("none", urls.resolve_link(L(""), page), None),
    ])


@pytest.mark.parametrize("value", ["a" * 10, "Ann"])
def test_fingerprint_is_case_free(spark, value):
    from rosterlens.operators.identity import stateless_fingerprint

    row = spark.range(1).select(stateless_fingerprint(N(), L(value)).alias("a"), stateless_fingerprint(L(""), L(f" {value.upper()} ")).alias("b")).first()
    assert row.a == row.b
