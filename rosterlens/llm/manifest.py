"""Merkle dataset manifest with sparse checkpoints.

Each document is a leaf; each language has a tree over its leaves, and one more tree joins the
languages' roots. Of a tree only every ``PERIOD``-th level is written (a *checkpoint*). The nodes
between two checkpoints form aligned subtrees of ``ARITY`` ** ``PERIOD`` nodes of the lower one.
Each subtree is one row of an aggregate, whatever the size of its tree, so a language with most
rows is as well spread as a small one. Building folds a subtree to its top and forgets the rest;
proofs walk from the root down and regenerate the levels of each subtree from the stored
descendants, emit every node's siblings, and forget them again. What is written for n leaves is
n / (ARITY ** PERIOD - 1) nodes besides the leaves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.operators.ordered import grouped_rank
from rosterlens.operators.skew import detach
from rosterlens.session import stage

ARITY, PERIOD = 2, 4


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text."""
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value: no two lists of values run into the same text."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return digest(F.concat(field(doc_id), field(source), field(lang), field(n_chars), field(text)))


@dataclass
class Forest:
    """Checkpoints (tree, pos, total, digest) from the leaves up; ``total`` counts the tree's nodes on that level. The last holds the roots."""

    checkpoints: list[DataFrame]
    arity: int
    period: int

    @property
    def roots(self) -> DataFrame:
        return self.checkpoints[-1].select("tree", "digest")


def _run_digest(nodes: Column, arity: int) -> Callable[[Column], Column]:
    return lambda run: digest(F.array_join(F.slice(nodes, run * arity + 1, F.lit(arity)), ""))


def _subtrees(nodes: DataFrame, forest: Forest, *extra: str) -> DataFrame:
    """One row for each aligned subtree: (tree, block, total, kept, level_0 ... level_<period>, open_1 ...).

    ``kept`` are the stored nodes in order; ``level_i`` the digests i levels above them. A tree
    that has come down to one node is not folded further.
    """
    width = forest.arity**forest.period
    ordered = F.array_sort(F.collect_list(F.struct("pos", "digest", *extra)))
    rows = nodes.groupBy("tree", F.floor(F.col("pos") / width).alias("block")).agg(F.first("total").alias("total"), ordered.alias("kept"))
    rows = rows.withColumn("level_0", F.col("kept.digest"))
    for i in range(forest.period):
        below = F.col(f"level_{i}")
        tops = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / forest.arity).cast("int"))
        joined = F.transform(tops, _run_digest(below, forest.arity))
        rows = rows.withColumn(f"level_{i + 1}", F.when(F.col("total") > forest.arity**i, joined).otherwise(below))
    return rows


def grow(leaves: DataFrame, arity: int = ARITY, period: int = PERIOD) -> Forest:
    """The forest over leaves (tree, pos, digest, ...), positions from 0 without gaps in each tree.

    The leaves must be a written table: they are the lowest checkpoint.
    """
    counts = stage(leaves.groupBy("tree").agg(F.count("*").alias("total")), "totals")
    most = counts.agg(F.max("total")).first()[0] or 0
    forest = Forest([leaves.join(detach(counts), "tree")], arity, period)
    while most > 1:
        folded = _subtrees(forest.checkpoints[-1], forest)
        total = F.ceil(F.col("total") / arity**period).cast("long")
        top = F.element_at(F.col(f"level_{period}"), 1)
        forest.checkpoints.append(stage(folded.select("tree", F.col("block").alias("pos"), total.alias("total"), top.alias("digest")), "checkpoint"))
        most = -(-most // arity**period)
    return forest


def _siblings(rows: DataFrame, forest: Forest) -> Column:
    """For every stored node of a subtree, its siblings level by level: array of arrays of (before, after)."""

    def of(place: Column) -> Column:
        steps = []
        for i in range(forest.period):
            at = F.floor(place / forest.arity**i).cast("int")
            level, own = F.col(f"level_{i}"), at % forest.arity
            before = F.slice(level, at - own + 1, own)
            after = F.slice(level, at + 2, F.lit(forest.arity - 1) - own)
            steps.append(F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after")))
        folded = F.aggregate(F.array(*[F.lit(forest.arity**i) for i in range(forest.period)]), F.lit(0), lambda n, size: n + (F.col("total") > size).cast("int"))
        return F.slice(F.array(*steps), F.lit(1), folded)

    return F.transform(F.sequence(F.lit(0), F.size("kept") - 1), of)


def descend(forest: Forest, tops: DataFrame, *extra: str) -> DataFrame:
    """(tree, pos, digest, *extra, path, top) of every leaf: ``path`` are its siblings up to the end of ``tops``' paths.

    ``tops`` is (tree, path, top): what follows above each root, and anything to hand down.
    ``extra`` are further columns of the leaves. Interior nodes live in the row of their subtree only.
    """
    above = tops.withColumn("block", F.lit(0).cast("long")).select("tree", "block", F.col("path").alias("above"), "top")
    if len(forest.checkpoints) == 1:  # lone leaves
        return forest.checkpoints[0].join(detach(above), "tree").select("tree", "pos", "digest", *extra, F.col("above").alias("path"), "top")
    for i in reversed(range(len(forest.checkpoints) - 1)):
        more = extra if i == 0 else ()
        rows = _subtrees(forest.checkpoints[i], forest, *more)
        pairs = F.arrays_zip(F.col("kept").alias("kept"), _siblings(rows, forest).alias("path"))
        found = rows.join(above, ["tree", "block"]).select("tree", "above", "top", F.explode(pairs).alias("n"))
        path = F.concat("n.path", "above")
        if i == 0:
            return found.select("tree", "n.kept.pos", "n.kept.digest", *[f"n.kept.{c}" for c in extra], path.alias("path"), "top")
        above = stage(found.select("tree", F.col("n.kept.pos").alias("block"), path.alias("above"), "top"), "paths")


def fold(start: Column, path: Column) -> Column:
    """The root that a node and its siblings lead to."""
    return F.aggregate(path, start, lambda below, step: digest(F.concat(step["before"], below, step["after"])))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf up and from left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""))


def manifest(leaves: DataFrame, arity: int = ARITY, period: int = PERIOD) -> DataFrame:
    """(doc_id, lang, leaf, ..., path, subroot, root) of rows (doc_id, lang, leaf, ...): every document's proof.

    The leaves of a language are ordered by ``doc_id``, null first, ties by leaf; equal rows are
    leaves of their own. Languages are ordered by their UTF-8 bytes, null (a language of its own)
    first. ``path`` lists (before, after) of each level up to the root, digests joined to one
    text; both are empty where a node is alone in its run. No rows give no rows; a single row is its own root,
    with an empty path. Columns named tree, pos, row, digest, path, subroot or root are replaced.
    """
    own = [c for c in leaves.columns if c not in ("tree", "pos", "row", "digest", "path", "subroot", "root")]
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    rows = leaves.select(*own).withColumns({"tree": tree, "digest": F.col("leaf"), "row": F.monotonically_increasing_id()})
    numbered = grouped_rank(stage(rows, "leaves"), ["tree"], ["doc_id", "digest", "row"], "pos").withColumn("pos", F.col("pos") - 1)
    languages = grow(stage(numbered.drop("row"), "numbered-leaves"), arity, period)
    subroots = languages.roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest")
    whole = grow(stage(grouped_rank(subroots, ["tree"], ["key"], "pos").withColumn("pos", F.col("pos") - 1), "subroots"), arity, period)
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    root = whole.roots.select("tree", nothing.alias("path"), F.col("digest").alias("top"))
    tops = descend(whole, root, "key").select(F.col("key").alias("tree"), "path", F.struct(F.col("digest").alias("subroot"), F.col("top").alias("root")).alias("top"))
    found = descend(languages, stage(tops, "tops"), *own)
    return found.select(*own, "path", "top.subroot", "top.root")


def tampered(doc_id: Column) -> Column:
    """Whether the test changes a document: where 7 divides the checksum of its id; a null id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def verified(docs: DataFrame, arity: int = ARITY, period: int = PERIOD) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, text, lang, source, n_chars).

    All digests are of the untampered table; ``folded_root`` is what the original siblings lead to
    from the tampered leaf, where the row is tampered (``n_chars`` + 1; null stays). Nulls in any
    column are values of their own. Cases as in ``manifest``; further columns are ignored.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col("n_chars") + 1 if i == 3 else c for i, c in enumerate(fields)]
    original = leaf(*fields)
    shown = F.when(tampered(F.col("doc_id")), leaf(*changed))
    found = manifest(docs.select("doc_id", "lang", original.alias("leaf"), shown.alias("other")), arity, period)
    folded = fold(F.coalesce("other", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
