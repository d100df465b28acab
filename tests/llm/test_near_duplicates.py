import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from rosterlens.llm import simhash
from rosterlens.llm.components import components


def naive_fingerprint(text, width=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\v\f\r":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(links, nodes):
    """Sets of nodes that links join."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        parent[find(a)] = find(b)
    out = defaultdict(set)
    for n in nodes:
        out[find(n)].add(n)
    return {frozenset(v) for v in out.values()}


def near(prints, bits):
    return [(a, b) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits]


def scattered(seed=3):
    rng = random.Random(seed)
    prints = {rng.getrandbits(64) for _ in range(80)}
    for base in list(prints)[:25]:
        for _ in range(rng.choice([1, 2, 20])):
            other = base
            for _ in range(rng.randint(1, 5)):
                other ^= 1 << rng.randrange(64)
            prints.add(other)
            base = rng.choice([base, other])
    dense = rng.getrandbits(64)
    for _ in range(100):
        prints.add(dense ^ sum(1 << b for b in rng.sample(range(0, 64, 5), rng.randint(0, 4))))
    return [p - (1 << 64) if p >> 63 else p for p in prints]


def test_fingerprints_equal_the_naive_ones(spark, words):
    texts = [None, "", " \t\n", "One", "one two three", "a b c d", "ÉA b c D e\x0bf g", "x y z " * 400, " ".join(words(300)), "no\xa0break and wide space here"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.fp for r in rows.select("doc_id", simhash.fingerprint(F.col("text")).alias("fp")).collect()}
    assert {k: v % (1 << 64) for k, v in got.items()} == {k: naive_fingerprint(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("segments", [None, 5])
def test_components_of_fingerprints_equal_all_pairs(spark, segments):
    prints = scattered()
    got = defaultdict(set)
    for r in simhash.link_components(spark.createDataFrame([(p,) for p in prints], "fp long"), 4, segments).collect():
        got[r.root].add(r.fp)
    assert {frozenset(v) for v in got.values()} == classes(near(prints, 4), prints)


def test_too_few_segments_are_refused():
    with pytest.raises(ValueError):
        simhash._masks(4, 2)


def test_long_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(200)]
    hub = [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def documents(spark, words):
    base = " ".join(words(60))
    rows = [(k, base if k < 30 else base + " end" if k < 33 else " ".join(words(50))) for k in range(40)]
    rows += [(7, base), (50, None), (51, ""), (None, base), (None, None), (52, "One"), (53, "one"), (60, "A" * 100_000)]
    return spark.createDataFrame([(k, t, "clash", "x") for k, t in rows], "doc_id long, text string, fp string, component_id string"), rows


def test_near_duplicates_of_odd_rows(spark, words):
    docs, rows = documents(spark, words)
    got = simhash.near_duplicates(docs).collect()
    prints = {t: naive_fingerprint(t) for _, t in rows}
    distinct = sorted(set(prints.values()))
    of = {p: c for c in classes(near(distinct, 4), distinct) for p in c}
    least = defaultdict(lambda: None)
    for k, t in rows:
        if k is not None:
            c = of[prints[t]]
            least[c] = k if least[c] is None else min(k, least[c])
    want = sorted(((k is None, k or 0, least[of[prints[t]]]) for k, t in rows))
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got)) == want


def test_one_of_each_group_stays(spark, words):
    docs, rows = documents(spark, words)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    prints = {t: naive_fingerprint(t) for _, t in rows}
    distinct = sorted(set(prints.values()))
    groups = classes(near(distinct, 4), distinct)
    got = kept.collect()
    assert len(got) == len(groups)
    assert {r.doc_id for r in got} == {min((k for k, t in rows if prints[t] in g and k is not None)) for g in groups}
    none = spark.createDataFrame([], docs.schema)
    assert simhash.keep_first(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_fingerprints_of_texts_over_several_blocks(words):
    rng = random.Random(6)
    few = words(50)
    for n in (simhash.BLOCK + 2, simhash.BLOCK + 3, simhash.BLOCK + 4, 2 * simhash.BLOCK + 100):
        for text in (" ".join(rng.choices(few, k=n)), "again " * n):
            assert simhash.fingerprint_of(text, 4) % (1 << 64) == naive_fingerprint(text)
