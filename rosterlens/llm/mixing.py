"""Mixing sources to target weights.

Words are summed per source, targets become repetition rates, and every document is emitted
``floor(rate)`` times plus one Bernoulli copy whose probability is the fraction that is left. The
draw hashes the document's id and text, so reruns agree and no state is kept.

Only sums per source are shuffled (combined before the shuffle, so a source with a third of all
rows sends one row a task). The table of sources is written out; its real size decides whether
Spark broadcasts it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.llm.text import words
from rosterlens.session import stage

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2


def _source_key(source: Column) -> Column:
    """Joins by equality and keeps a null source apart from an empty one."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, total_share: float = TOTAL_SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """(source_key, source, source_size, target, rate) from rows of (source, size).

    Sources in code point order, null last, get the weights in turn. Targets share
    ``total_share`` of all words by weight but stop at ``most`` times their source's size; what is
    cut off is shared again among the others. The level at which this settles is found in one
    pass: sources reach their limit in the order of limit / weight.

    One row per source: the windows below order sources, not documents.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    limits = per_source.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * most)
    full = Window.orderBy("at", F.col("source").isNull(), "source")
    everything = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        limits.withColumn("at", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(total_share)))
        .withColumn("full_before", F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("open_weight"))
        .withColumn("settled", F.first(F.when(F.col("level") <= F.col("at"), F.col("level")), True).over(everything))
    )
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("settled") * F.col("weight"), F.col("most").cast("double")))
    return levels.select(
        _source_key(F.col("source")).alias("source_key"), "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the document alone, from 52 bits of a digest."""
    seed = F.concat_ws("|", F.lit("mix"), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(rate: Column, doc_id: Column, text: Column) -> Column:
    """How often a document is emitted: the whole part of the rate, and one more by a draw against the fraction."""
    whole = F.floor(rate)
    return (whole + (draw(doc_id, text) < rate - whole).cast("long")).cast("long")


def plan(docs: DataFrame, **shares) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row.

    Null text and null source: size 0, and a source of its own. A source without words has target 0
    and rate 0. Repeated rows draw alike. No rows give no rows; further columns are ignored.
    """
    sizes = stage(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), draw(F.col("doc_id"), F.col("text")).alias("draw")), "sizes")
    targets = stage(source_targets(sizes, **shares), "targets").drop("source")
    joined = sizes.withColumn("source_key", _source_key(F.col("source"))).join(targets, "source_key")
    whole = F.floor("rate")
    count = (whole + (F.col("draw") < F.col("rate") - whole).cast("long")).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", count.alias("copies"))


def mix(docs: DataFrame, **shares) -> DataFrame:
    """The mixed corpus: each document as often as its source's rate says, with all its columns and ``copy`` (1, 2, ...).

    An own column ``copy`` is replaced. Cases as in ``plan``.
    """
    sizes = docs.select("source", F.size(words(F.col("text"))).cast("long").alias("size"))
    targets = stage(source_targets(sizes, **shares), "targets").select("source_key", "rate")
    rows = docs.drop("copy").select(F.struct("*").alias("row")).withColumn("source_key", _source_key(F.col("row.source")))
    count = copies(F.col("rate"), F.col("row.doc_id"), F.col("row.text"))
    repeated = rows.join(targets, "source_key").withColumn("count", count).where("count > 0")
    return repeated.select("row.*", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))
