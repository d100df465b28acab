"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words with their counts. For every sample ``k`` and term, two gamma
variates ``r`` and ``c`` and a uniform ``b`` come from hashes of (term, k) alone, and the term with
the smallest

    ln a = ln c - r (t - b + 1),   t = floor(ln(weight) / r + b)

is sampled together with its ``t``. Two texts get the same sample with a probability equal to
their generalised Jaccard similarity, sum(min) / sum(max) of the weights. As ``a`` is a function of
(term, t), its value identifies the sample; a fingerprint keeps 16 bits of its hash for each ``k``.

Everything is column expressions: weights are counted inside the row by sorting the word hashes, so
no (document, word) pair is shuffled, and the samples are minima of plain numbers, which one hash
aggregate keeps for all ``k`` at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.llm.text import let, words
from rosterlens.session import stage

SAMPLES = 32
KEYS = ("no_id", "known_id", "content")


def term_weights(text: Column) -> Column:
    """The distinct words of a text, as hashes, with their counts; null for a text without words."""
    def runs(hashes: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: (i == 0) | (F.get(hashes, i) != F.get(hashes, i - 1)))
        counted = let(starts, lambda s: F.transform(s, lambda at, j: F.struct(
            F.get(hashes, at).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(hashes)) - at).alias("weight"))))
        return F.when(F.size(hashes) > 0, counted)

    return let(F.sort_array(F.transform(words(text), lambda w: F.xxhash64(w))), runs)


def _gamma(h: Column) -> Column:
    """A Gamma(2, 1) variate from the two halves of a hash."""
    one = F.shiftrightunsigned(h, 32) + F.lit(0.5)
    two = h.bitwiseAND(0xFFFFFFFF) + F.lit(0.5)
    return -(F.log(one * two) - F.lit(44.3614195558365))  # ln(2^64)


def _sample(k: int) -> Column:
    """ln a of one term for sample ``k``, from the columns ``term`` and ``log_weight``."""
    r = _gamma(F.xxhash64("term", F.lit(3 * k)))
    c = _gamma(F.xxhash64("term", F.lit(3 * k + 1)))
    b = F.shiftrightunsigned(F.xxhash64("term", F.lit(3 * k + 2)), 11) / F.lit(float(1 << 53))
    t = F.floor(F.col("log_weight") / r + b)
    return F.log(c) - r * (t - b + 1)


def signatures(rows: DataFrame, by: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """(by..., codes): the fingerprint of each row's text as an array of 16-bit numbers; -1 throughout for texts without words.

    ``by`` must tell the rows apart. Rows that are dealt by ``by`` already are not moved.
    """
    terms = rows.select(*by, F.explode_outer(term_weights(F.col(text))).alias("t"))
    terms = terms.select(*by, "t.term", F.log(F.col("t.weight").cast("double")).alias("log_weight"))
    least = terms.groupBy(*by).agg(*[F.min(_sample(k)).alias(f"a{k}") for k in range(samples)])
    code = [F.when(F.col(f"a{k}").isNull(), -1).otherwise(F.xxhash64(f"a{k}").bitwiseAND(0xFFFF).cast("int")) for k in range(samples)]
    return least.select(*by, F.array(*code).alias("codes"))


def as_text(codes: Column, samples: int = SAMPLES) -> Column:
    """The fingerprint as four hexadecimal digits a sample."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.get(codes, F.lit(k)).bitwiseAND(0xFFFF)), 4, "0")) for k in range(samples)])


def likeness(one: Column, two: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples: an unbiased estimate of the generalised Jaccard similarity, 0 to 1."""
    equal = [(F.get(one, F.lit(k)) == F.get(two, F.lit(k))).cast("int") for k in range(samples)]
    return sum(equal[1:], equal[0]) / F.lit(float(samples))


def _keyed(docs: DataFrame) -> DataFrame:
    """(KEYS, text): what tells documents apart, without nulls. ``known_id`` falls as the id grows."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").isNull().alias("no_id"), F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).alias("known_id"),
        F.xxhash64(text).alias("content"), text.alias("text"),
    )


def followers(docs: DataFrame) -> DataFrame:
    """(KEYS, n_chars, rows, next): every distinct document and the one after it by descending id; the first follows the last.

    The order is cut into ranges; a range's last document is followed by the first of the next
    range that has any. Only keys are moved, not texts.
    """
    place = F.struct(*KEYS)
    distinct = _keyed(docs).groupBy(*KEYS).agg(F.count("*").alias("rows"), F.max(F.length("text")).cast("long").alias("n_chars"))
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = stage(distinct.repartitionByRange(ranges, *KEYS).withColumn("part", F.spark_partition_id()), "ordered-keys")
    firsts = cut.groupBy("part").agg(F.min(place).alias("first"))
    parts = Window.orderBy("part")
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(parts), F.first("first").over(whole)).alias("after"))
    inside = cut.withColumn("next", F.lead(place).over(Window.partitionBy("part").orderBy(*KEYS)))
    return inside.join(after, "part").select(*KEYS, "rows", "n_chars", F.coalesce("next", "after").alias("next"))


def edited_copies(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, codes, edited_codes, next_codes) for every row.

    The edited text replaces the last third of a text by the beginning of the next document.
    Null texts are empty; texts without words have the codes -1, alike among themselves. Rows that
    repeat an id and text are one document, given as often as they occur; rows that share an id
    only follow each other by a hash of their text; rows without an id come last. A single document
    follows itself. No rows give none; further columns are ignored.
    """
    order = stage(followers(docs), "followers")
    take = F.floor(F.col("n_chars") / 3).cast("int")
    before = order.select(*[F.col("next")[k].alias(k) for k in KEYS], F.struct(*KEYS).alias("before"), take.alias("give"))
    texts = _keyed(docs).dropDuplicates(list(KEYS)).join(before, list(KEYS))
    heads = texts.select(*[F.col("before")[k].alias(k) for k in KEYS], F.substring("text", F.lit(1), F.col("give")).alias("head"), F.col("give").alias("cut"))
    kept = F.substring("text", F.lit(1), F.length("text") - F.col("cut"))
    pairs = texts.select(*KEYS, "text").join(heads, list(KEYS)).select(*KEYS, "text", F.concat(kept, "head").alias("edited"))
    both = pairs.select(*KEYS, F.explode(F.array(
        F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("text")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text")))).alias("v"))
    versions = both.select(*KEYS, "v.is_edited", "v.text")
    hashed = versions.withColumn("sha", F.when(F.col("is_edited"), F.sha2(F.col("text").cast("binary"), 256)))
    signed = stage(signatures(hashed, [*KEYS, "is_edited", "sha"], "text", samples), "signatures")
    own = signed.where("not is_edited").select(*KEYS, "codes")
    edited = signed.where("is_edited").select(*KEYS, F.col("sha").alias("edited_sha256"), F.col("codes").alias("edited_codes"))
    following = own.select(*[F.col(k).alias(f"next_{k}") for k in KEYS], F.col("codes").alias("next_codes"))
    flat = order.select(*KEYS, "rows", "n_chars", *[F.col("next")[k].alias(f"next_{k}") for k in KEYS])
    joined = flat.join(own, list(KEYS)).join(edited, list(KEYS)).join(following, [f"next_{k}" for k in KEYS])
    doc_id = F.when(~F.col("no_id"), F.bitwise_not("known_id"))
    one = joined.select(doc_id.alias("doc_id"), "n_chars", "edited_sha256", "codes", "edited_codes", "next_codes", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"))
    return one.drop("copy")
