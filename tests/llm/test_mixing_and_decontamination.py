import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from rosterlens.llm import decontamination, mixing


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by repeated sharing: each round the open sources share what is left by weight; those above their limit stop at it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_equal_repeated_sharing(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 23):
        sizes = {None if k == 0 else f"s{k}é" if k % 2 else f"S{k}": rng.choice([0, 1, 5, 100, 10_000]) for k in range(n)}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        want = filled(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)


def mix_rows(words):
    rng = random.Random(8)
    rows = [(k, " ".join(words(rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "c", None, ""])) for k in range(900)]
    return rows + [(5, None, "a"), (None, "x y", "b"), (3, "same\ttext  here", "c"), (3, "same\ttext  here", "c")]


def test_mix_comes_near_its_targets(spark, words):
    rows = mix_rows(words)
    docs = spark.createDataFrame([(k, t, s, 1, "z") for k, t, s in rows], "doc_id long, text string, source string, copy int, rate string")
    plan = mixing.plan(docs).collect()
    assert len(plan) == len(rows)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in plan:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        size[r.source] += r.size
        target[r.source] = r.target
    want = filled(dict(size))
    for s in want:
        assert math.isclose(target[s], want[s], abs_tol=1e-6) and abs(taken[s] - want[s]) <= 0.1 * want[s] + 60
    assert sorted(map(str, plan)) == sorted(map(str, mixing.plan(docs.repartition(7)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "text", "source", "rate", "copy"]
    assert mixed.count() == sum(r.copies for r in plan)


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], none.schema)
    assert [r.copies for r in mixing.plan(blank).collect()] == [0, 0]


def shingle_set(text):
    found = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    return {" ".join(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def contained(docs, items):
    best = {}
    for d, text in docs:
        held = shingle_set(text)
        for i, asked_text in items:
            asked = shingle_set(asked_text)
            if asked and len(asked & held) >= math.ceil(0.8 * len(asked) - 1e-9):
                best[d, i] = max(best.get((d, i), 0), len(asked & held) / len(asked))
    return best


def cases(words):
    rng = random.Random(6)
    items = [(k, " ".join(words(n))) for k, n in enumerate([1, 3, 5, 6, 9, 12, 20, 33, 40, 64, 65, 130])]
    items += [(90, None), (91, ""), (92, "?!"), (None, " ".join(words(15))), (5, items[5][1])]
    docs = []
    for k in range(120):
        body = words(rng.choice([0, 3, 30, 400]))
        for _, text in rng.sample(items, 2):
            passage = (text or "").split()
            for _ in range(rng.choice([0, 0, 1, 3])):  # an altered word costs up to five shingles
                if passage:
                    passage[rng.randrange(len(passage))] = "altered"
            if rng.random() < 0.3:
                passage = [w.upper() + "," for w in passage]
            at = rng.randint(0, len(body))
            body[at:at] = passage
        docs.append((k, " ".join(body)))
    return docs + [(3, docs[3][1]), (4, docs[5][1]), (None, docs[6][1]), (None, "clean words only"), (200, None), (201, ""), (202, "long " * 30_000)], items


def test_contained_items_equal_brute_force(spark, words):
    docs, items = cases(words)
    left = spark.createDataFrame([(k, t, "a", 0) for k, t in docs], "doc_id long, text string, hash string, row int")
    right = spark.createDataFrame([(k, t, "b") for k, t in items], "item_id long, text string, hits string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontamination.contained_items(left, right).collect()}
    assert got == contained(docs, items) and len(got) > 50
    kept = decontamination.decontaminate(left, right)
    assert kept.columns == left.columns
    clean = [(k, t) for k, t in docs if not contained([(k, t)], items)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, clean))
    assert decontamination.decontaminate(left, right.limit(0)).count() == len(docs)
    assert decontamination.contained_items(left.limit(0), right).count() == 0


def test_a_passage_of_all_items_is_in_no_sketch(spark):
    rng = random.Random(12)
    template = "please choose the best answer to the question below and explain it"
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(60)]
    items = spark.createDataFrame([(k, f"{template} {text}") for k, text in enumerate(own)], "item_id long, text string")
    named = items.select(F.col("item_id").alias("item"), F.col("text").alias("item_text"))
    sketched = decontamination.item_sketches(named.union(named.limit(5)))
    common = spark.createDataFrame([(template,)], "t string").select(F.explode(decontamination.shingle_hashes(F.col("t"))).alias("hash"))
    assert sketched.join(common, "hash").count() == 0
    assert sketched.groupBy("item", "hash").count().where("count > 1").count() == 0
    docs = [(k, f"noise before {template} and noise after") for k in range(50)] + [(100 + k, f"a b {template} {own[k]} c d") for k in range(3)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    pairs = decontamination.contained_items(docs, items).select("doc_id", "item_id").collect()
    assert sorted((r.doc_id, r.item_id) for r in pairs) == [(100, 0), (101, 1), (102, 2)]
