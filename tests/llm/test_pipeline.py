import corpus_pipeline
from rosterlens.llm import queries
from rosterlens.session import stage

SMALL = "/root/testdata/sf0.001"


def test_every_query_runs_and_sql_names_exist(spark):
    assert sorted(k.split("_")[0] for k in queries.QUERIES) == sorted(f"op{n}" for n in range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op2_toxicity", "op4_language_id", "op9_lm_scoring", "op10_token_counts"):
        assert queries.QUERIES[name](spark, SMALL).count() == n


def test_stages_keep_what_they_should(spark, words):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(3).collect()]
    rows = [tuple(r) for r in docs.collect()]
    top = max(r[0] for r in rows)
    clean = next(r for r in rows if len(r[1]) > 3000)
    rows += [(top + 1, clean[1] + " more", "en", "srcX", 1), (top + 2, f"{clean[1][:900]} {items[0]} {clean[1][900:1800]}", "en", "srcX", 1)]
    rows += [(top + 3, "12 34", "en", "srcX", 5), (top + 4, None, None, None, None)]
    planted = stage(spark.createDataFrame(rows, docs.schema), "planted")
    ids, current = {}, planted
    for name, function in corpus_pipeline.STAGES:
        result = stage(function(spark, current, SMALL), name)
        ids[name] = {r.doc_id for r in result.select("doc_id").collect()}
        assert set(ids[name]) <= {r.doc_id for r in current.select("doc_id").collect()}
        if name != "source_mixing":
            assert result.columns == docs.columns
        current = result
    assert top + 3 not in ids["language_id"] and top + 4 not in ids["language_id"] and len(ids["language_id"]) >= 200
    assert top + 1 not in ids["simhash_near_dedup"]
    assert top + 2 not in ids["benchmark_decontamination"]
    assert len(ids["source_mixing"]) > 0.7 * len(ids["benchmark_decontamination"])


def test_an_empty_table_passes(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SMALL), name)
        assert docs.count() == 0, name
