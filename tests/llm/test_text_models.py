import random

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from rosterlens.llm import language, token_counts, toxicity

NO_DOCS = "doc_id long, text string, lang string, score double, found string"


def toxic_corpus(words, n=600):
    rng = random.Random(2)
    plain = words(200)
    docs, labels = [], []
    for k in range(n):
        body = rng.choices(plain, k=rng.choice([3, 40, 300]))
        toxic = k % 6 == 0
        for _ in range(max(1, len(body) // 40) if toxic else 0):
            body[rng.randrange(len(body))] = "gruk" + rng.choice(["", "ba", "ke", "zu", "mira"])
        docs.append((k, " ".join(body)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_toxic_documents_are_told_apart(spark, words):
    docs, labels = toxic_corpus(words)
    left = spark.createDataFrame([(k, t, "en", 0.5, "x") for k, t in docs], NO_DOCS)
    right = spark.createDataFrame([(k, y, 1) for k, y in labels if k % 4 != 2] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(left.where("doc_id % 4 <> 2"), right)
    scored = toxicity.with_score(left.where("doc_id % 4 = 2"), model, "p").select("doc_id", "p").collect()
    truth = dict(labels)
    assert all((r.p >= toxicity.THRESHOLD) == bool(truth[r.doc_id]) for r in scored) and len(scored) == 150
    odd = spark.createDataFrame([(1, None, "a", 0.0, None), (None, "", None, None, "y"), (2, "?! 12", "a", 0.0, "z"), (2, "plain " * 50_000, "a", 0.0, "z")], NO_DOCS)
    kept = toxicity.keep_ordinary(odd, model)
    assert kept.columns == odd.columns and kept.count() == 4
    assert toxicity.keep_ordinary(odd.limit(0), model).count() == 0


def test_toxicity_without_one_class(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for rows in ([], [(1, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        p = toxicity.with_score(docs, model).first().score
        assert 0 <= p < toxicity.THRESHOLD


def test_shared_backoff_is_a_distribution():
    grams, follow = toxicity._grams({"bake": 3, "baku": 1, "nuke": 2})
    shared = toxicity.SharedBackoff(set(grams))
    letters = {g[-1] for g in grams}
    for context in ("", "a", "^b", "k", "xyz"):
        total = sum(shared.probability(context, c) for c in letters)
        assert total <= 1 + 1e-9 and total > 0.9
        assert shared.probability(context, "?") > 0


def test_mild_words_count():
    model = toxicity.Model({"^a": 1.0, "^b": 2.0}, {})
    none, mild, more = toxicity.evidence(model, pd.Series(["", "a x x", "a b x"]), {})
    assert none == 0 < mild < more


def test_long_runs_are_scored_whole():
    model = toxicity.Model({"bbbbbx": 5.0}, {})
    run = "b" * 100
    plain, toxic = toxicity.evidence(model, pd.Series([run, run + "x"]), {})
    assert plain == 0 < toxic
    assert len(model.ratios(run + "x")) == 2 and len(model.ratios("b" * 64)) == 1
    assert "bbbbbx" in toxicity._grams({run + "x": 1})[0]


def language_corpus(n=400):
    rng = random.Random(5)
    parts = {"aa": ["ba", "ke", "lo", "mi"], "bb": ["schu", "gro", "tzen", "ich"], "cc": ["çao", "ñe", "ílo", "ba"]}
    rows = []
    for k in range(n):
        lang = rng.choice(list(parts))
        rows.append((k, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.choice([4, 30, 200]))), lang))
    return rows


def test_languages_are_learnt(spark):
    rows = language_corpus()
    docs = spark.createDataFrame([(*r, 0.1, "x") for r in rows], NO_DOCS)
    model = language.train(docs.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r.guess for r in language.with_language(docs.drop("found").where("doc_id % 4 = 2"), model).select("doc_id", F.col("found").alias("guess")).collect()}
    truth = {k: lang for k, _, lang in rows}
    assert sum(got[k].language == truth[k] for k in got) >= 0.98 * len(got)
    odd = [(1, None), (2, ""), (3, "12 ?!"), (None, "ba ke lo mi " * 60_000)]
    found = language.with_language(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    assert [r.found.language for r in found] == ["und", "und", "und", "aa"] and [r.found.rejected for r in found] == [True, True, True, False]
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * len(rows)
    assert language.keep_identified(docs.limit(0), model).count() == 0
    nothing = language.train(docs.limit(0))
    assert nothing is None and language.with_language(docs.drop("found").limit(1), nothing).first().found.language == "und"


def test_what_was_not_learnt_is_rejected(spark):
    rows = language_corpus(600)
    docs = spark.createDataFrame([(k, t, lang, 0.1, "x") for k, t, lang in rows], NO_DOCS)
    model = language.train(docs.where("doc_id % 4 <> 2"))
    rng = random.Random(4)
    shuffled = ["".join(rng.sample(t, len(t))) for k, t, _ in rows if k % 4 == 2 and len(t) > 150]
    other = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Wszyscy ludzie rodzą się wolni i równi pod względem", "x" * 500, "x " * 500]
    clean = [t for k, t, _ in rows if k % 4 == 2]
    mixed = [" ".join(rng.sample(clean[k].split() + clean[k + 1].split(), len(clean[k].split()))) for k in range(0, 60, 2)]
    rejects = lambda text: (lambda got: model.rejects(float(got[0].max()), got[1]))(model.judge(text))
    assert all(map(rejects, shuffled + other)) and len(shuffled) > 50
    assert sum(map(rejects, clean)) == 0
    assert sum(model.judge(t)[1] < model.usual.least for t in mixed) == 0
    assert sum(model.judge(t * 40)[1] < model.usual.least for t in clean) == 0  # repeats are not stranger than the text


def test_usual_equals_ngram_by_ngram():
    model = language.fit(*map(list, zip(*[language.counts_of(t) for _, t, _ in language_corpus(80)])), np.arange(80) % 3, ("a", "b", "c"))
    text = "Bake, loMi  12 çao-ñe schu"
    parts = np.concatenate(list(language.buckets_of(text))).tolist()
    p = [sum(float(model.scores[b, k]) for b in parts) / len(parts) + model.bias[k] for k in range(3)]
    e = np.exp(np.array(p) - max(p))
    mean = sum(float(model.usual.of_bucket[b]) for b in parts) / len(parts)
    error = (model.usual.within ** 2 / len(set(parts)) + model.usual.between ** 2) ** 0.5
    got = model.judge(text)
    assert np.allclose(got[0], e / e.sum(), atol=1e-5) and np.isclose(got[1], (mean - model.usual.mean) / error, rtol=1e-4)


def test_the_sample_is_bounded_and_has_rare_languages(spark):
    rows = [(None, f"text {k}", "aa") for k in range(4000)] + [(7, "same", "aa")] * 3000 + [(k, f"rare {k}", "bb") for k in range(12)] + [(None, None, "cc"), (None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.sampled(docs, sample=300, per_language=10).collect()
    sizes = {lang: sum(r.lang == lang for r in got) for lang in ("aa", "bb", "cc")}
    assert 150 <= sizes["aa"] <= 300 and sizes["bb"] == 10 and sizes["cc"] == 0 and sum(r.text == "same" for r in got) <= 1
    assert sorted(r.text for r in got) == sorted(r.text for r in language.sampled(docs.repartition(9), sample=300, per_language=10).collect())


def test_pieces_of_long_texts_add_up(monkeypatch):
    text = "Bake, loMi  12 çao-ñe " * 50
    whole = np.sort(np.concatenate(list(language.buckets_of(text))))
    monkeypatch.setattr(language, "PIECE", 37)
    cut = np.sort(np.concatenate(list(language.buckets_of(text))))
    # a cut inside a run of separators may repeat one gap; letters are never lost
    assert abs(len(cut) - len(whole)) <= 0.05 * len(whole)
    assert np.isin(whole, cut).all()


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts_equal_the_library(spark, tokenizer_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path)
    rng = random.Random(9)
    kinds = [lambda: chr(rng.randint(32, 126)), lambda: chr(rng.choice([9, 10, 13, 28, 0x85, 0xA0, 0x2003, 0x3000])), lambda: chr(rng.randint(0xA1, 0x2FF)), lambda: rng.choice("abc the 's 're 12 ٣ ½ 中文 ñ é ".split(" ")), lambda: chr(rng.choice([0x1F600, 0x10940, 0x558, 0xE000, 0x301]))]
    texts = ["".join(rng.choice(kinds)() for _ in range(rng.randint(1, 120))) for _ in range(400)]
    texts += ["", None, "a<|endoftext|>b <|endoftext|>", " " * 500, "ab" * 30_000, "the cat " * 20_000]
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.measured(docs, tokenizer_path, most=50).collect()}
    for k, t in enumerate(texts):
        want = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (want, len((t or "").encode()), want > 512), repr(t)[:80]
    assert token_counts.measured(docs.limit(0), tokenizer_path).count() == 0


def test_split_and_unknown_characters_cover_the_library(tokenizer_path):
    """Every character that the own split treats differently is one that goes to the library."""
    from tokenizers import Tokenizer

    pre, split, unknown = Tokenizer.from_file(tokenizer_path).pre_tokenizer, regex.compile(token_counts.SPLIT), token_counts._unknown_characters()
    for c in [*range(1, 0xD800), *range(0xE000, 0x3400, 1), *range(0x10000, 0x12000), *range(0x1D000, 0x1F000)]:
        ch = chr(c)
        text = f"a{ch}1{ch} {ch}{ch} !{ch}!"
        ends, at = [], 0
        for piece in split.findall(text):
            at += len(piece)
            ends.append(at)
        assert ends == [span[1] for _, span in pre.pre_tokenize_str(text)] or unknown.search(text), hex(c)


def test_the_cache_is_bounded(tokenizer_path, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 10)
    count = token_counts.counter(tokenizer_path, {" a": 1})
    from tokenizers import Tokenizer

    text = " ".join(f"word{k} a" for k in range(100))
    assert count([text, "", text]) == [len(Tokenizer.from_file(tokenizer_path).encode(t, add_special_tokens=False).ids) for t in (text, "", text)]


def test_repeated_rows_get_equal_languages(spark):
    docs = spark.createDataFrame([(k, t, lang, 0.1, "x") for k, t, lang in language_corpus(200)], NO_DOCS)
    model = language.train(docs)
    rows = docs.limit(20).union(docs.limit(20)).union(spark.createDataFrame([(None, None, "aa", 0.1, "own"), (None, None, "aa", 0.1, "own")], NO_DOCS))
    kept = [tuple(r) for r in language.keep_identified(rows, model).collect()]
    assert len(kept) % 2 == 0 and all(kept.count(r) % 2 == 0 for r in kept) and {r[4] for r in kept} == {"x"}
    named = language.with_language(rows, model, "guess")
    assert named.columns == [*rows.columns, "guess"] and named.where("found = 'own'").count() == 2
