"""Benchmark decontamination: which documents contain at least a share of a test item's shingles.

Test items are short and documents long, so the Jaccard similarity of the two says nothing
(0.002 for a 40-word item inside a 20,000-word document); banded signatures of whole documents
would miss them. Containment is searched from the item's side instead:

* items are partitioned by size (powers of two of their distinct shingles);
* an item is sketched by its MinHash sample: the ``s`` smallest hashes of its shingles, those shared by fewest items first. The sketch
  size belongs to the partition. A document that contains the share ``t`` of ``q`` shingles
  misses at most ``q - ceil(t q)`` of them, so with ``s`` above that number at least
  ``s - (q - ceil(t q))`` sketch hashes are among the document's: no contained item is missed;
* documents with fewer shingles than an item needs are never its candidates;
* candidates are verified by exact containment of the shingles themselves, as text.

Documents are not shuffled: their shingle hashes meet the sketches in the scan when the sketches
are small enough for Spark to broadcast (their written size decides), else in a hash join that
moves one number a shingle. Only candidates are moved with their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.text import let
from rosterlens.operators.skew import detach
from rosterlens.session import stage

SHINGLE = 5
CONTAINED = 0.8
SPARE_HASHES = 2


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits: case and punctuation around a copied passage do not matter."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def shingles(text: Column, width: int = SHINGLE) -> Column:
    """All runs of ``width`` tokens as text, repeats included; shorter texts are one shingle, empty ones none."""
    def of(parts: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(parts) - (width - 1)), lambda i: F.array_join(F.slice(parts, i, width), " "))
        return F.when(F.size(parts) >= width, many).when(F.size(parts) > 0, F.array(F.array_join(parts, " ")))

    return F.coalesce(let(tokens(text), of), F.array().cast("array<string>"))


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """One 64-bit hash per shingle, made of the hashes of its tokens; null for texts without tokens."""
    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
        few = F.array(F.aggregate(hashes, F.lit(17).cast("long"), lambda a, h: F.xxhash64(a, h)))
        return F.when(n >= width, many).when(n > 0, few)

    return let(F.transform(tokens(text), lambda w: F.xxhash64(w)), of)


def item_sketches(items: DataFrame, width: int = SHINGLE, contained: float = CONTAINED, spare: int = SPARE_HASHES) -> DataFrame:
    """(item, hash, needed, hits): the sketch hashes of every item, its least number of shingles in a document, and of sketch hashes.

    A document with ``needed`` of an item's ``q`` shingles holds all but ``q - needed`` of any sketch of it. So the sketch takes the
    smallest hashes among the shingles that fewest items share: a passage that many items have in common
    (a template of questions) would else bring every document that holds it together with every one of these items.
    """
    hashed = items.select("item", F.array_distinct(shingle_hashes(F.col("item_text"), width)).alias("hashes")).where("hashes is not null").distinct()
    single = stage(hashed.select("item", F.explode("hashes").alias("hash")), "item-shingles")
    shared = single.groupBy("hash").agg(F.count("*").alias("items"))
    ranked = single.join(detach(shared), "hash").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("items", "hash")))["hash"].alias("hashes"))
    sized = ranked.withColumn("q", F.size("hashes")).withColumn("needed", F.ceil(F.col("q") * contained - 1e-9).cast("int"))
    # the partition of the size decides the sketch: enough for its largest item, and some to spare
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("q"))).cast("int")
    sketch = F.least("q", (upper - F.ceil(upper * contained - 1e-9) + 1 + spare).cast("int"))
    sketched = sized.withColumn("s", sketch).withColumn("hits", F.greatest(F.lit(1), F.col("s") - (F.col("q") - F.col("needed"))))
    return sketched.select("item", "needed", "hits", F.explode(F.slice("hashes", F.lit(1), F.col("s"))).alias("hash"))


def candidates(docs: DataFrame, sketches: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(row, item): documents that hold enough sketch hashes of an item."""
    hashed = docs.select("row", F.explode(let(shingle_hashes(F.col("doc_text"), width), lambda h: F.transform(h, lambda x: F.struct(x.alias("hash"), F.size(h).alias("n"))))).alias("s")).select("row", "s.hash", "s.n")
    met = hashed.join(sketches, "hash").where("n >= needed").groupBy("row", "item", "hash").agg(F.max("hits").alias("hits"))
    return met.groupBy("row", "item").agg(F.count("*").alias("found"), F.max("hits").alias("hits")).where("found >= hits").select("row", "item")


def _matches(docs: DataFrame, items: DataFrame, width: int, contained: float) -> DataFrame:
    """(row, item, n_shingles, n_found) of verified pairs, from (row, doc_text) and (item, item_text)."""
    items = stage(items, "items")
    pairs = stage(candidates(docs, stage(item_sketches(items, width, contained), "sketches"), width), "candidates")
    texts = stage(docs.join(pairs.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"]), "candidate-texts")
    held = texts.select("row", F.array_distinct(shingles(F.col("doc_text"), width)).alias("held"))
    asked = items.dropDuplicates(["item"]).select("item", F.array_distinct(shingles(F.col("item_text"), width)).alias("asked"))
    checked = pairs.join(asked, "item").join(held, "row").select("row", "item", F.size("asked").alias("n_shingles"), F.size(F.array_intersect("asked", "held")).alias("n_found"))
    return checked.where(F.col("n_found") >= F.ceil(F.col("n_shingles") * contained - 1e-9))


def _named(rows: DataFrame, id_column: str, text_column: str, name: str, text_name: str) -> DataFrame:
    """Rows named by their id and a hash of their text: a struct, in which nulls are equal to each other."""
    return rows.select(F.struct(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("content")).alias(name), F.col(text_column).alias(text_name))


def contained_items(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text_column: str = "text", width: int = SHINGLE, contained: float = CONTAINED,
) -> DataFrame:
    """(id, item, n_shingles, n_found, containment) for every document that contains ``contained`` of an item's distinct shingles.

    Texts are compared by their tokens. Items and documents without tokens match nothing; shorter
    texts than a shingle are one shingle. Rows that repeat an id and text, or an item id and text,
    are one; a repeated id with other text is judged by each of its texts, and the best containment
    counts. Null ids are kept as an id of their own. Empty tables give no rows; further columns are ignored.
    """
    found = _matches(_named(docs, id_column, text_column, "row", "doc_text"), _named(items, item_column, item_text_column, "item", "item_text"), width, contained)
    best = F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_found"))
    pairs = found.groupBy(F.col("row.id").alias(id_column), F.col("item.id").alias(item_column)).agg(best.alias("best"))
    return pairs.select(id_column, item_column, "best.n_shingles", "best.n_found", "best.containment")


def decontaminate(docs: DataFrame, items: DataFrame, item_column: str = "item_id", width: int = SHINGLE, contained: float = CONTAINED) -> DataFrame:
    """The documents that contain no test item, with all their columns and repeats.

    A row goes when its id and text are those of a match. What goes is little against the corpus;
    Spark decides by its written size how to join. Cases as in ``contained_items``.
    """
    found = _matches(_named(docs, "doc_id", "text", "row", "doc_text"), _named(items, item_column, "text", "item", "item_text"), width, contained)
    found = stage(found.select("row").distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("whole"), F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("content")).alias("row"))
    return rows.join(found, "row", "left_anti").select("whole.*")
