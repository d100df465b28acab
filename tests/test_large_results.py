"""Deep pages and frequent values against plain sorting and counting."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rosterlens.operators.topk import frequency_bound, top_values
from rosterlens.plans.paging import paged


def test_pages_are_those_of_the_sorted_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(9)]), i) for i in range(503)]
    result = paged(spark.createDataFrame(rows, "a int, b int"), [F.desc("a"), F.col("b")], limit=10, ranges=7)
    want = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1), r[1]))
    assert (result.total, result.pages) == (503, 51)
    for page in (1, 2, 17, 50, 51):
        assert [(r.a, r.b, r.position) for r in result.page(page).collect()] == [(*r, (page - 1) * 10 + i) for i, r in enumerate(want[(page - 1) * 10 : page * 10])]
    assert result.page(0).count() == result.page(52).count() == 0


def test_a_page_reads_its_own_ranges(spark):
    result = paged(spark.range(10_000).withColumn("text", F.md5(F.col("id").cast("string"))), [F.col("id")], limit=20, ranges=10)
    page = result.page(400)
    assert [r.id for r in page.collect()] == list(range(7980, 8000))
    first, last = result.ranges_of(400)
    assert 0 < first <= last <= first + 1
    assert "PartitionFilters: [isnotnull(range" in page._jdf.queryExecution().executedPlan().toString()


def test_pages_of_nothing(spark):
    result = paged(spark.createDataFrame([], "a int"), [F.col("a")], limit=5)
    assert (result.total, result.pages, result.page(1).count()) == (0, 0, 0)
    with pytest.raises(ValueError, match="at least one"):
        paged(spark.createDataFrame([], "a int"), [F.col("a")], limit=0)


@pytest.mark.parametrize(("k", "buckets", "tracked"), [(1, 4, 100), (5, 1000, 100), (40, 64, 100), (500, 64, 1000)])
def test_top_values_are_exact(spark, k, buckets, tracked):
    rng = random.Random(k)
    values = [rng.choice([None, "", "x", "y"]) for _ in range(200)] + [f"v{int(rng.paretovariate(0.6)) % 300}" for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "value string").repartition(5)
    got = [(r.value, r["count"]) for r in top_values(df, k, tracked, buckets).collect()]
    counts = Counter(v for v in values if v is not None)
    assert got == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
    bound = frequency_bound(df.where("value is not null"), k, tracked)
    assert sum(n >= bound for n in counts.values()) >= min(k, len(counts))


def test_top_values_of_nothing(spark):
    assert top_values(spark.createDataFrame([], "value string"), 3).count() == 0
