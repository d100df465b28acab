"""SimHash near-duplicates through deletion-variant signatures.

A text's fingerprint has a bit set where more than half of its shingle hashes have it. Two texts
are linked when their fingerprints differ in at most ``bits`` bits.

Search: the 64 bits are cut into ``bits // 2 + 1`` segments - fewer than an exact match of one
segment would need - so that one segment of a linked pair differs in at most one bit. Each segment
is indexed once for each of its bits with that bit blanked out. Linked pairs share such a variant;
an equality join finds them and the whole fingerprints verify them.

Groups of very many near copies: the join never lists their pairs. Within a variant, every
fingerprint is compared with a few before it in order; the few rows that a variant usually has are
thereby settled, and dense groups are tied together at a few links a row. Only rows of larger
variants that still belong to different components are joined, and then only those outside the
variant's largest component with all others. No link between components is lost.

The longer the kept part of a variant, the fewer strangers share it. More segments keep several of
them together (``segments``: 5 keep 24 bits in 256 variants, against 20 bits in 64), for tables of
very many different texts; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens.llm.components import components
from rosterlens.operators.skew import detach
from rosterlens.session import spread, stage

WIDTH = 64
SEED = 42
BLOCK = 1 << 15
NEIGHBOURS = 3


def fingerprint_of(text: str | None, shingle: int) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    line = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = starts[shingle:] or starts[-1:]
    ones = np.zeros(WIDTH, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(ends), BLOCK):
        h = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts[k : k + BLOCK], ends[k : k + BLOCK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(ends), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """SimHash of the lower-cased word shingles; null and blank texts have fingerprint 0."""

    @F.pandas_udf(T.LongType())
    def simhash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([fingerprint_of(x, shingle) for x in part], dtype="int64")

    return simhash(text)


def as_hex(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), WIDTH // 4, "0"))


def _masks(bits: int, segments: int | None) -> list[int]:
    """The kept bits of every variant: some segments without one of their bits."""
    segments = segments or bits // 2 + 1
    if 2 * segments <= bits:
        raise ValueError("some segment must differ in one bit at most: more than bits / 2 segments are needed")
    together = max(1, segments - bits + 1)  # so many segments differ in one bit at most, taken together
    edges = [WIDTH * k // segments for k in range(segments + 1)]
    parts = [range(low, high) for low, high in zip(edges, edges[1:])]
    masks = []
    for chosen in combinations(parts, together):
        kept = [bit for part in chosen for bit in part]
        masks += [sum(1 << other for other in kept if other != bit) for bit in kept]
    return masks


def _variants(bits: int, segments: int | None) -> Column:
    """The one-wildcard variants of ``fp`` as an array of keys: hashes of the variant's number and its kept bits."""
    signed = [m - (1 << WIDTH) if m >> (WIDTH - 1) else m for m in _masks(bits, segments)]
    return F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)])


def _near(left: str, right: str, bits: int) -> Column:
    return F.bit_count(F.col(left).bitwiseXOR(F.col(right))) <= bits


def _meeting(prints: DataFrame, bits: int, segments: int | None) -> DataFrame:
    """(key, fp, links, open) of variants that several fingerprints share.

    Every row is compared with the ``NEIGHBOURS`` before it in fingerprint order. ``links`` are
    those that verify; for the one just before, the start of the run of linked neighbours. Variants
    of more rows than that stay ``open``: not all their pairs have been compared.
    """
    index = spread(prints, "fp").select("fp", F.explode(_variants(bits, segments)).alias("key"))
    ordered = Window.partitionBy("key").orderBy("fp")
    rows = index.withColumn("size", F.count("*").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    for k in range(1, NEIGHBOURS + 1):
        rows = rows.withColumn(f"before_{k}", F.lag("fp", k).over(ordered))
    rows = rows.withColumn("near", F.coalesce(_near("fp", "before_1", bits), F.lit(False)))
    rows = rows.withColumn("start", F.last(F.when(~F.col("near"), F.col("fp")), True).over(ordered))
    further = [F.when(_near("fp", f"before_{k}", bits), F.col(f"before_{k}")) for k in range(2, NEIGHBOURS + 1)]
    links = F.array_compact(F.array(F.when(F.col("near"), F.col("start")), *further))
    rows = rows.where("size > 1").select("key", "fp", links.alias("links"), (F.col("size") > NEIGHBOURS + 1).alias("open"))
    return rows.where((F.size("links") > 0) | F.col("open"))


def _across(meeting: DataFrame, labels: DataFrame, bits: int) -> DataFrame:
    """Links between fingerprints of different components that share a variant."""
    of_key = Window.partitionBy("key")
    mixed = (
        meeting.where("open").select("key", "fp")
        .join(detach(labels), "fp")
        .withColumn("least", F.min("root").over(of_key))
        .withColumn("most", F.max("root").over(of_key))
        .where("least < most")
        .withColumn("largest", F.max(F.struct("size", "root")).over(of_key)["root"])
        .select("key", "fp", "root", (F.col("root") != F.col("largest")).alias("outside"))
    )
    mixed = stage(mixed, "mixed-variants")
    left = mixed.where("outside").select("key", F.col("fp").alias("a"), F.col("root").alias("root_a"))
    right = mixed.select("key", F.col("fp").alias("b"), F.col("root").alias("root_b"))
    return left.join(right.hint("merge"), (left.key == right.key) & (F.col("root_a") != F.col("root_b")) & _near("a", "b", bits)).select("a", "b")


def link_components(prints: DataFrame, bits: int = 4, segments: int | None = None) -> DataFrame:
    """(fp, root) of the distinct fingerprints ``fp``: equal roots where a chain of links of at most ``bits`` bits joins them."""
    meeting = stage(_meeting(prints, bits, segments), "meeting-variants")
    first = components(meeting.select("fp", F.explode("links").alias("link")))
    first = stage(prints.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "first-labels")
    sizes = first.groupBy("root").agg(F.count("*").alias("size"))
    labels = stage(first.join(detach(sizes), "root").select("fp", "root", "size"), "sized-labels")
    across = _across(meeting, labels, bits)
    roots = labels.select("fp", "root")
    ends = across.join(detach(roots).select(F.col("fp").alias("a"), F.col("root").alias("x")), "a").join(
        detach(roots).select(F.col("fp").alias("b"), F.col("root").alias("y")), "b"
    )
    second = components(ends.select("x", "y"))
    joined = labels.join(detach(second.select(F.col("node").alias("root"), F.col("root").alias("top"))), "root", "left")
    return joined.select("fp", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """(id, fp, component_id) for every row: the smallest id that chains of near copies reach.

    Texts: null and blank ones have fingerprint 0 and are linked like any other; fewer words than a
    shingle make one shingle. Repeated rows give repeated rows. A row without an id belongs to its
    component, whose id is the smallest given one (null where no row has an id). No rows give none;
    further columns are ignored.
    """
    rows = stage(docs.select(F.col(id_column).alias("id"), fingerprint(F.col(text_column), shingle).alias("fp")), "fingerprints")
    prints = stage(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    roots = stage(link_components(prints.select("fp"), bits).join(prints, "fp"), "roots")
    named = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = roots.select("fp", "root").join(detach(named), "root").select("fp", "component_id")
    return rows.join(detach(labels), "fp").select(F.col("id").alias(id_column), "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest ``doc_id``, with all its columns.

    Among rows without any id, and among rows that share the smallest id, the one with the smallest
    hash of its text stays. Exact repeats of a row leave one row. Empty texts are a group of their own.
    """
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("content"))
    rows = stage(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("content"), fingerprint(F.col("text"), shingle).alias("fp")), "fingerprints")
    roots = link_components(stage(rows.select("fp").distinct(), "distinct-fingerprints"), bits)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "content")
    counted = rows.groupBy("fp", "id", "content").agg(F.count("*").alias("copies"))
    least = counted.groupBy("fp").agg(F.min(F.struct(order.alias("place"), "copies")).alias("least"))
    kept = stage(roots.join(least, "fp").groupBy("root").agg(F.min("least").alias("least")).select("least.place.id", "least.place.content", "least.copies"), "kept")
    # a row without an id cannot meet another by equality: null ids are compared as a flag and a number
    safe = [F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("known_id"), "content"]
    keys = ["no_id", "known_id", "content"]
    whole = whole.select("row", *safe)
    single = whole.join(kept.where("copies = 1").select(*safe), keys, "left_semi").select("row.*")
    repeated = whole.join(kept.where("copies > 1").select(*safe), keys, "left_semi").select("row.*")
    return single.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
