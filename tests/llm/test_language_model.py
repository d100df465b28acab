import inspect
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rosterlens.llm import language_model, recurrent


def small():
    shape = recurrent.Shape(64, 3)
    rng = np.random.default_rng(1)
    flat = recurrent.initial(shape, rng.integers(1, 50, 67)).astype(np.float64)
    return shape, flat + rng.normal(0, 0.05, len(flat)), rng


def log_softmax(x):
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def naive(shape, flat, tokens):
    """ln P of one text, token by token."""
    p, h, last, total, s = shape.views(flat), np.zeros(recurrent.STATE), recurrent.END, 0.0, recurrent.STATE
    for token in tokens:
        x, a = p["embed"][last] @ p["wx"] + p["b"], h @ p["wh"]
        z, r = (1 / (1 + np.exp(-(x[k : k + s] + a[k : k + s]))) for k in (0, s))
        n = np.tanh(x[2 * s :] + r * a[2 * s :])
        h = n + z * (h - n)
        c = int(shape.class_of(np.array([token]))[0])
        total += log_softmax((h @ p["wc"] + p["bc"])[None])[0, c]
        if token < shape.n_head:
            total += log_softmax((h @ p["ww"][c] + p["bw"][c])[None])[0, token % recurrent.HEAD_CLASS]
        last = token
    return total


def test_scores_equal_token_by_token():
    shape, flat, rng = small()
    texts = [np.append(rng.integers(1, 67, n), 0) for n in (0, 1, 15, 16, 17, 90, 3)]
    got = recurrent.Scorer(shape, flat.astype(np.float32), window=16, batch=4).score(texts)
    assert np.allclose(got, [naive(shape, flat, t) for t in texts], rtol=1e-4)


def test_gradients_equal_differences():
    shape, flat, rng = small()
    x = rng.integers(0, 67, (6, 3))
    x[3, 1] = recurrent.END
    y = rng.integers(0, 67, (6, 3))

    def loss(v):
        # with no parameter gradient wanted, the same code gives the loss through scoring lane by lane from each END
        total = 0.0
        for lane in range(3):
            p, h, s = shape.views(v), np.zeros(recurrent.STATE), recurrent.STATE
            for t in range(6):
                h = h * (x[t, lane] != recurrent.END)
                i, a = p["embed"][x[t, lane]] @ p["wx"] + p["b"], h @ p["wh"]
                z, r = (1 / (1 + np.exp(-(i[k : k + s] + a[k : k + s]))) for k in (0, s))
                n = np.tanh(i[2 * s :] + r * a[2 * s :])
                h = n + z * (h - n)
                c = int(shape.class_of(y[t, lane : lane + 1])[0])
                total -= log_softmax((h @ p["wc"] + p["bc"])[None])[0, c]
                if y[t, lane] < shape.n_head:
                    total -= log_softmax((h @ p["ww"][c] + p["bw"][c])[None])[0, y[t, lane] % recurrent.HEAD_CLASS]
        return total / 18

    grad = np.zeros_like(flat)
    recurrent._window(shape, shape.views(flat), shape.views(grad), np.zeros((recurrent.STATE, 3)), x, y)
    for at in shape.views(np.arange(len(flat))).values():
        at = at.reshape(-1)
        for k in (at[np.argmax(np.abs(grad[at]))], *rng.choice(at, 3)):
            step = np.zeros_like(flat)
            step[k] = 1e-5
            assert math.isclose((loss(flat + step) - loss(flat - step)) / 2e-5, grad[k], rel_tol=2e-3, abs_tol=1e-6)


def test_training_lowers_the_loss():
    shape = recurrent.Shape(32, 4)
    rng = np.random.default_rng(3)
    stream = np.concatenate([[0]] + [np.append(rng.choice([1, 2, 3] if k % 2 else [32, 33, 9], 20), 0) for k in range(400)])
    flat = recurrent.initial(shape, np.bincount(stream, minlength=36))
    texts = [np.append(rng.choice([1, 2, 3] if k % 2 else [32, 33, 9], 20), 0) for k in range(20)]
    before = recurrent.Scorer(shape, flat).score(texts).sum()
    after = recurrent.Scorer(shape, recurrent.train_on(shape, flat, stream, 0.02)).score(texts).sum()
    assert after > 0.8 * before


def corpus():
    rng = random.Random(12)
    parts = [["ba", "ke", "lo"], ["schu", "gro", "zen"]]
    rows = [(k, " ".join("".join(rng.choices(parts[k % 2], k=rng.randint(1, 3))) for _ in range(rng.choice([2, 30, 150])))) for k in range(300)]
    return rows + [(400, None), (401, ""), (402, "\t"), (7, rows[7][1]), (None, "Ba KE é unknownword"), (403, "unseen " * 3)]


def test_base_scores_equal_counting(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n int, row string")
    split = {t: (t or "").encode().lower().split() for _, t in rows}
    learnt = [t for k, t in rows if k is not None and k % 7 != 2 and k != 403]
    counts = Counter(w for t in learnt for w in split[t])
    counts["end"] = len(learnt)
    total, distinct = sum(counts.values()), len(counts)
    training = F.coalesce((F.col("doc_id") % 7 != 2) & (F.col("doc_id") != 403), F.lit(False))
    got = language_model.scored(docs, training).collect()
    assert len(got) == len(rows)

    def wanted(t):
        tokens = [*split[t], "end"]
        base = sum(math.log10((counts[w] + 1) / (total + 1 * (distinct + 1))) for w in tokens)
        return len(tokens), sum(counts[w] > 0 for w in tokens), round(base, 6)

    key = lambda k, *rest: (k is None, k or 0, *rest)
    assert sorted(key(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted(key(k, *wanted(t)) for k, t in rows)
    assert {r.train_tokens for r in got} == {total}
    assert all(r.score < 0 for r in got)
    held = [r for r in got if not r.training and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = language_model.scored(docs, F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in sorted(got, key=lambda r: r.doc_id)] == [(3, 0, 0), (1, 0, 0)]
    assert language_model.scored(docs.limit(0), F.lit(True)).count() == 0


def test_sixty_endings_are_sixty_classes(spark):
    """Words outside the head keep a class for each of 64 endings and 32 for the others; steps are of 32 lanes."""
    head = [(f"head{k}", 10) for k in range(language_model.N_HEAD - 1)]
    rare = [(f"rare{chr(97 + k // 8)}{chr(97 + k % 8)}x", 1) for k in range(60)]
    counts = spark.createDataFrame([(w, k, c) for k, (w, c) in enumerate(head + rare)], "word string, h long, c long")
    v = language_model.vocabulary(counts, 5)
    assert len({v.class_of(w.encode()) for w, _ in rare}) == 60
    assert v.shape.n_tail == 96 and inspect.signature(recurrent.train_on).parameters["batch"].default == 32


def test_the_rounds_take_every_training_document(spark):
    rows = [(k if k % 3 else None, " ".join([f"w{k}"] * (k + 1))) for k in range(90)] + [(500, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = docs.select(language_model._round(F.col("doc_id"), F.col("text")).alias("r"), "doc_id").collect()
    rounds = set(range(len(language_model.ROUNDS)))
    assert len(got) == len(rows) and {r.r for r in got} == rounds
    assert {r.r for r in got if r.doc_id is None} == rounds


def test_no_token_is_left_out_of_the_lanes(monkeypatch):
    seen = Counter()
    monkeypatch.setattr(recurrent, "_window", lambda shape, p, g, h, x, y: seen.update(y.reshape(-1).tolist()) or h)
    stream = np.arange(4 * 20 * 7 + 6)
    recurrent.train_on(recurrent.Shape(32, 4), np.zeros(recurrent.Shape(32, 4).length, np.float32), stream, 0.01)
    assert set(seen) == set(range(1, len(stream)))


def test_parameters_are_averaged_in_a_tree(spark):
    rng = np.random.default_rng(3)
    arrays, weights = rng.normal(0, 1, (200, 5)), rng.integers(1, 9, 200).astype(float)
    rows = [(k, bytearray((a * w).tobytes()), float(w)) for k, (a, w) in enumerate(zip(arrays, weights))]
    got = language_model._weighted_mean(spark.createDataFrame(rows, language_model.SUMS).repartition(7), np.zeros(5, np.float32))
    assert np.allclose(got, np.average(arrays, axis=0, weights=weights), atol=1e-6)
    none = language_model._weighted_mean(spark.createDataFrame([], language_model.SUMS), np.ones(5, np.float32))
    assert none.tolist() == [1] * 5


def test_head_words_where_one_count_is_too_frequent_for_a_table(spark, monkeypatch):
    monkeypatch.setattr(language_model, "FREQUENT", 100)
    counts = spark.range(3000).selectExpr("concat('w', lpad(id, 4, '0')) as word", "id as h", "7L as c")
    v = language_model.vocabulary(counts, 5)
    assert v.n_words == language_model.N_HEAD - 1 and list(v.frequent)[:2] == [b"w0000", b"w0001"]
    assert v.class_words.sum() == 3000 - v.n_words and v.distinct == 3001


def test_texts_are_numbered_as_bytes_are_split(spark):
    texts = [None, "", " \t\n\x0b\x0c\r ", "ÀB  É é\x1c\x1d\x85\xa0y\x00z", " Ba ke ", "".join(map(chr, range(1, 300))), "ke new ba New other", "x"]
    counts = spark.createDataFrame([("ba", 1, 5), ("ke", 2, 4), ("é", 3, 4)], "word string, h long, c long")
    v = language_model.vocabulary(counts, 2)
    numbering = language_model.Numbering(v)
    got = numbering.numbered(pa.array(["cut off", *texts], pa.string())[1:])
    split = [(t or "").encode().lower().split() for t in texts]
    assert got.lengths.tolist() == [len(s) + 1 for s in split]
    assert got.at.tolist() == [k for s in split for k in [*(v.frequent.get(w, -2) + 1 for w in s), 0]]
    assert [w.encode() for w in got.others.to_pylist()] == [w for s in split for w in s if w not in v.frequent]
    assert got.tokens.tolist() == [k for s in split for k in [*(v.frequent[w] + 1 if w in v.frequent else language_model.N_HEAD + v.class_of(w) for w in s), 0]]
    of = np.repeat(np.arange(len(texts)), got.lengths)[got.at < 0]
    listed = language_model._counted(got.others, of, len(texts)).to_pylist()
    assert [{r["word"].encode(): r["n"] for r in x} for x in listed] == [Counter(w for w in s if w not in v.frequent) for s in split]


def test_words_are_counted_as_bytes_are_split(spark):
    texts = [None, "", "  ", "A a\x0bB\x1cb É é", "b " * 500]
    got = language_model.word_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r.word.encode(): r.c for r in got} == Counter(w for t in texts for w in (t or "").encode().lower().split())


def test_windows_of_training_make_no_large_arrays():
    """What numpy makes anew in every window is cleared by the system each time: the arrays of all classes and blocks are kept."""
    shape, rng = recurrent.Shape(1024, 96), np.random.default_rng(2)
    flat = recurrent.initial(shape, rng.integers(1, 50, 1120))
    grad, x = np.zeros_like(flat), rng.integers(0, 1120, (21, 32))
    window = lambda: recurrent._window(shape, shape.views(flat), shape.views(grad), np.zeros((recurrent.STATE, 32), np.float32), x[:-1], x[1:])
    window()
    tracemalloc.start()
    window()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000


def test_one_work_array_serves_windows_of_other_texts():
    """Results do not depend on what the kept arrays held before."""
    shape, flat, rng = small()
    flat = flat.astype(np.float32)
    streams = [np.concatenate([[0], rng.integers(0, 67, 1500)]) for _ in range(2)]
    first = recurrent.train_on(shape, flat, streams[0], 0.01)
    recurrent.train_on(shape, flat, streams[1], 0.01)
    assert np.array_equal(first, recurrent.train_on(shape, flat, streams[0], 0.01))
    texts = [np.append(rng.integers(1, 67, n), 0) for n in (40, 3, 700, 0, 16)]
    scorer = recurrent.Scorer(shape, first, batch=2)
    alone = np.concatenate([recurrent.Scorer(shape, first).score([t]) for t in texts])
    assert np.allclose(scorer.score(texts), alone, rtol=1e-5) and np.allclose(scorer.score(texts[::-1]), alone[::-1], rtol=1e-5)


def test_slices_of_batches_keep_all_their_words(spark):
    texts = [" ".join(f"w{j}" for j in range(5 + k % 7)) for k in range(300)]
    counts = spark.createDataFrame([("w1", 1, 5), ("w2", 2, 4)], "word string, h long, c long")
    numbering = language_model.Numbering(language_model.vocabulary(counts, 2))
    for low, high in ((0, 100), (100, 200), (250, 300)):
        for kind in (pa.string(), pa.large_string()):
            got = numbering.numbered(pa.array(texts, kind)[low:high])
            assert got.lengths.tolist() == [6 + k % 7 for k in range(low, high)]
            assert got.others.to_pylist() == [w for t in texts[low:high] for w in t.split() if w not in ("w1", "w2")]
