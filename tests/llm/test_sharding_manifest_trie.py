"""The scheduling, the manifest and the trie against plain single-machine versions."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest

from rosterlens.llm import manifest, sharding, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lpt(weights, shards):
    heap, out = [(0, s) for s in range(shards)], []
    for weight in weights:
        load, shard = heapq.heappop(heap)
        out.append(shard)
        heapq.heappush(heap, (load + weight, shard))
    return out


@pytest.mark.parametrize("shards", [1, 2, 3, 8])
def test_runs_of_turns_are_the_plain_walk(shards):
    rng = random.Random(shards)
    for _ in range(150):
        classes = sorted({rng.choice([1, 2, 3, 7, 50, 1000, 99_999]) * rng.randint(1, 4): rng.choice([1, 2, 5, 40, 700]) for _ in range(6)}.items(), reverse=True)
        want = lpt([w for w, n in classes for _ in range(n)], shards)
        got = []
        counts = dict(classes)
        for weight, runs in sharding.schedule(classes, shards):
            starts = [s for s, _ in runs] + [counts[weight]]
            for (start, turns), end in zip(runs, starts[1:], strict=True):
                got += [turns[i % len(turns)] for i in range(end - start)]
        assert got == want


def some_docs(words):
    texts = [" ".join(words(n)) for n in (1, 2, 3, 5, 8, 40)]
    rng = random.Random(5)
    rows = [(i, rng.choice(texts + ["", None, "é" * 30, "x"]), rng.choice(["en", "de", None, ""]), rng.choice(["s", None]), rng.choice([None, 3])) for i in range(150)]
    rows += [(None, "no id", "en", "s", 1), (None, "no id", "en", "s", 1), (7, "again", "fr", "s", 1), (7, "again", "fr", "s", 1), (999, "y" * 200_000, "en", "s", 1)]
    return rows


def test_shards_are_those_of_the_plain_walk(spark, words):
    rows = some_docs(words)
    weights = defaultdict(int)
    for _, text, *_ in rows:
        weights[text or ""] += len((text or "").encode()) + 1
    order = sorted(weights, key=lambda t: (-weights[t], hashlib.sha256(t.encode()).digest()))
    home = dict(zip(order, lpt([weights[t] for t in order], 8), strict=True))
    docs = spark.createDataFrame([(*r, 1, "own") for r in rows], DOCS + ", row int, key string")
    got = sharding.placed(docs).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), home[t or ""]) for i, t, *_ in rows)
    assert Counter(r[:4] for r in got) == want
    for shard in range(8):
        held = sorted(((r.slot, r.doc_id) for r in got if r.shard == shard))
        assert [s for s, _ in held] == list(range(len(held)))
        assert [d is not None for _, d in held] == sorted(d is not None for _, d in held)


def test_shard_column_and_files(spark, words, tmp_path):
    rows = some_docs(words)
    docs = spark.createDataFrame([(*r, 1, "own") for r in rows], DOCS + ", size int, key string").withColumnRenamed("source", "shard")
    marked = sharding.with_shard(docs, 3)
    assert sorted(marked.columns) == sorted(docs.columns)
    assert Counter((r.doc_id, r.text, r.lang, r.size, r.key) for r in marked.collect()) == Counter((r[0], r[1], r[2], 1, "own") for r in rows)
    sharding.write_shards(docs, str(tmp_path / "out"), 3, rows_per_file=20)
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.count() == len(rows) and {r.shard for r in read.select("shard").distinct().collect()} == {0, 1, 2}
    assert read.groupBy("text").agg({"shard": "min"}).count() == len({r[1] for r in rows})


def test_no_documents_no_shards(spark):
    empty = spark.createDataFrame([], DOCS)
    assert sharding.placed(empty).count() == 0 and sharding.with_shard(empty).count() == 0


def plain_tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + arity])) for i in range(0, len(below), arity)])
    return levels


def plain_path(levels, at, arity):
    path = []
    for level in levels[:-1]:
        first = at - at % arity
        path.append(("".join(level[first:at]), "".join(level[at + 1 : first + arity])))
        at //= arity
    return path


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(doc_id, text, lang, source, n_chars):
    return sha("".join(map(shown, (doc_id, source, lang, n_chars, text))))


def plain_manifest(rows, arity):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r, plain_leaf(*r)))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in order:
        trees[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        built[lang] = plain_tree([leaf for _, leaf in trees[lang]], arity)
    top = plain_tree([built[lang][-1][0] for lang in order], arity)
    for n, lang in enumerate(order):
        for at, (r, leaf) in enumerate(trees[lang]):
            path = plain_path(built[lang], at, arity) + plain_path(top, n, arity)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = plain_leaf(*r[:4], r[4] if r[4] is None else r[4] + 1) if hit else leaf
            for before, after in path:
                now = sha(before + now + after)
            proof = sha("".join(b + a for b, a in path))
            yield r[0], leaf, built[lang][-1][0], top[-1][0], proof, now, now == top[-1][0]


@pytest.mark.parametrize(("arity", "period"), [(2, 4), (2, 1), (3, 2)])
def test_manifest_and_proofs(spark, words, arity, period):
    rows = some_docs(words)
    docs = spark.createDataFrame([(*r, 1, "own", 2) for r in rows], DOCS + ", pos int, tree string, row int")
    got = manifest.verified(docs, arity, period).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows, arity))
    assert not all(r.verified for r in got) and any(r.verified for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 16, 17])
def test_manifest_sizes(spark, n):
    rows = [(i, f"text {i}", "en", "s", 3) for i in range(n)]
    got = manifest.verified(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows, 2))


def test_only_every_fourth_level_is_written(spark):
    rows = spark.range(300).selectExpr("'=en' AS tree", "id AS pos", "sha2(cast(id AS string), 256) AS digest")
    forest = manifest.grow(rows)
    assert [c.count() for c in forest.checkpoints] == [300, 19, 2, 1]
    assert forest.roots.first().digest == plain_tree([sha(str(i)) for i in range(300)], 2)[-1][0]


def plain_trie(conversations):
    members, ends, size = defaultdict(list), defaultdict(list), {(): 0}
    for conv_id, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv_id)
            if d:
                size[turns[:d]] = len(turns[d - 1][1].encode())
        ends[turns].append(conv_id)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for path, ids in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(ids) - 1) * size[path]
            leaves[path[:d]] += not children[path]
    for path, ids in members.items():
        yield (
            min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), children[path], leaves[path], saved[path],
            sha(",".join(map(str, sorted(ends[path])))),
        )


def plain_conversations(turns):
    said = defaultdict(list)
    for conv_id, turn, role, text in turns:
        if conv_id is not None:
            said[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: tuple((r, t) for *_, r, t in sorted(rows)) for c, rows in said.items()}
    out = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = said.get(base, ())[:h] + own[h:]
    return out


TURNS = "conv_id long, turn long, role string, text string"


def some_turns():
    rng = random.Random(3)
    rows = []
    for c in list(range(120)) + [-3, -5, 10**12]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["hi", "how", "é", "", None, "well then"])))
    for c in range(1000, 1200):
        rows += [(c, t, "user", "same start") for t in range(9)]
    rows += [(None, 1, "user", "nobody")] * 3 + [(5, 1, "user", "twice")] * 2
    return rows


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_trie_does_not_depend_on_shards(spark, shards, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    rows = some_turns()
    turns = spark.createDataFrame([(*r, 1, "own") for r in rows], TURNS + ", place int, id string")
    got = trie.conversation_trie(turns, shards).collect()
    assert Counter(map(tuple, got)) == Counter(plain_trie(plain_conversations(rows)))


def test_long_conversations_and_none(spark):
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(c, t, "user", f"turn {t if t < 4000 else t + c}") for c in (5, 6, 7) for t in range(5000)]
    got = trie.conversation_trie(spark.createDataFrame(rows, TURNS), 3).collect()
    assert len(got) == 1 + 4000 + 1000 * len({plain_conversations(rows)[c] for c in (5, 6, 7)})
    assert {r.n_leaves for r in got if r.depth == 0} == {3}
    assert {(r.n_convs, r.n_children) for r in got if r.depth == 4000} == {(3, 3)}


def test_medians_and_tree_depth():
    assert sorted(trie.medians(100)) == list(range(100)) and next(trie.medians(100)) == 50
    tree = trie.TernaryTree()
    for i in trie.medians(1023):
        tree.insert((i,), (1,))

    def depth(node):
        return 0 if not node else 1 + max(depth(tree.smaller[node]), depth(tree.larger[node]))

    assert depth(tree.next[0]) == 10
    assert [n for n, _, _ in tree.walk()][0] == 0 and len(list(tree.walk())) == 1024
