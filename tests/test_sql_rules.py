"""Page rules as table functions of SQL."""

import pytest

from rosterlens.operators import sql_rules
from rosterlens.operators.extraction import PythonRule

RULE = PythonRule("listed", lambda html, url: [{"name": n, "title": "T", "room": i} for i, n in enumerate(html.split(","))] if html else None)
SCHEMA = "page_id long, other string, url string, html string"


@pytest.fixture
def pages(spark):
    rows = [(1, "x", "https://A.test/p", "Ann,,Ben"), (2, "x", "http://sub.a.test:80/q", "Cat"), (3, "x", "https://nota.test", "Dan"), (4, "x", None, "Eve"), (5, "x", "u", None), (6, "x", "u", "")]
    spark.createDataFrame(rows + rows[:1], SCHEMA).createOrReplaceTempView("rule_pages")
    sql_rules.register_table_rule(spark, RULE)
    return "rule_pages"


def test_rows_are_those_of_the_rule(spark, pages):
    rows = spark.sql(f"SELECT * FROM listed(TABLE({pages}))")
    assert rows.columns == ["page_id", "url", "rule", "ord", "name", "title", "email", "phone", "category", "profile_url"]
    assert sorted((r.page_id, r.ord, r.name) for r in rows.collect()) == [(1, 0, "Ann"), (1, 0, "Ann"), (1, 2, "Ben"), (1, 2, "Ben"), (2, 0, "Cat"), (3, 0, "Dan"), (4, 0, "Eve")]
    assert {r.rule for r in rows.collect()} == {"listed"}


def test_one_host_and_extras(spark, pages):
    rows = spark.sql(f"SELECT page_id, name, extras FROM listed(TABLE({pages}), host => 'A.test', extras => true)").collect()
    assert sorted((r.page_id, r.name, r.extras["room"]) for r in rows) == [(1, "Ann", "0"), (1, "Ann", "0"), (1, "Ben", "2"), (1, "Ben", "2"), (2, "Cat", "0")]


def test_only_needed_columns_are_read_and_nothing_moves(spark, pages, tmp_path):
    spark.table(pages).write.parquet(str(tmp_path / "p"))
    rows = spark.sql("SELECT * FROM listed(TABLE({p}))", p=spark.read.parquet(str(tmp_path / "p")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "other" not in plan.split("ReadSchema")[1]


def test_wrong_calls_fail_at_analysis(spark, pages):
    for call in ("listed(TABLE(SELECT 1 AS page_id))", f"listed(TABLE({pages}), host => 7)", "listed('x')"):
        with pytest.raises(Exception, match="listed"):
            spark.sql(f"SELECT * FROM {call}").schema


def test_no_pages_give_no_people(spark, pages):
    assert spark.sql("SELECT * FROM listed(TABLE(SELECT * FROM rule_pages WHERE page_id < 0))").count() == 0


def test_hosts():
    assert [sql_rules.host_of(u) for u in ("https://U:p@A.test:8/x", "http://b.test?x", "b.test", None, "")] == ["a.test", "b.test", "", "", ""]
