"""Language-model scoring: a gated recurrent network over a class-factored vocabulary, and corpus counts.

Counts of all training tokens are aggregated in Spark, one row per word; they grow with the corpus
and stay distributed. From them come the base score of add-one smoothing, the head words of the
network, and the probabilities of all other words within their class (a class is a frequent ending
of words, or a hash of a rare one). The network sees head words and classes: it learns which comes
next from whole documents in order, by truncated backpropagation in numpy. Every round takes another
slice of the training documents, and the slices together are all of them; every input partition
trains on its part of the slice, and the partitions' parameters are averaged in Spark after the round. Head words are chosen by a softmax of their own that depends on the state.

Scoring reads every text once, whole, with the network's state carried through all of it. Counts of
the ``FREQUENT`` most frequent words are broadcast; the other words of each document are joined
with the counts by hash. The broadcast tables and the parameters have a fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens.llm import recurrent
from rosterlens.llm.text import share
from rosterlens.session import stage, spread

N_HEAD = 1024
ENDINGS = 64
HASHED = 32
ENDING = 3
FREQUENT = 100_000
ROUNDS = (0.02, 0.01, 0.005)
SLICE = 4096
FAN_IN = 64
LN10 = float(np.log(10))


@dataclass(frozen=True)
class Vocabulary:
    """What a worker needs to number words: frequent words with their counts, endings, and the sizes of the classes."""

    frequent: dict[bytes, int]
    counts: np.ndarray
    n_words: int
    endings: dict[bytes, int]
    class_tokens: np.ndarray
    class_words: np.ndarray
    total: int
    distinct: int
    ends: int

    @property
    def shape(self) -> recurrent.Shape:
        return recurrent.Shape(N_HEAD, ENDINGS + HASHED)

    def class_of(self, word: bytes) -> int:
        """The number of a word's class, from 0."""
        end = word[-ENDING:]
        k = self.endings.get(end)
        return ENDINGS + zlib.crc32(end) % HASHED if k is None else k


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts, one after another, and how many each text has. Null is empty."""
    whole = texts.take(pa.array(np.arange(len(texts))))  # a slice shares the offsets of its array, which the functions below do not all heed
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(whole.cast(pa.large_string()), "")))
    words, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    filled = pc.greater(pc.binary_length(words), 0)  # white space at either end of a text makes an empty word
    seen = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return words.filter(filled), np.diff(seen[bounds])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, h, c): every lower-cased word of the texts, its hash and its number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _split(batch.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "c"])

    each = docs.select("text").mapInArrow(count, "word string, c long")
    return each.groupBy("word").agg(F.sum("c").alias("c")).select("word", F.xxhash64("word").alias("h"), "c")


def _ending(word: Column) -> Column:
    return F.substring(word.cast("binary"), -ENDING, ENDING)


def _least_count(counts: DataFrame) -> int:
    """The count that at most ``FREQUENT`` words reach, from a histogram of a few hundred steps of the counts."""
    step = F.floor(F.log2("c") * 16)
    rows = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect(), key=lambda r: -r["step"])
    n, least = 0, 1 << 62
    for r in rows:
        n += r["n"]
        if n > FREQUENT:
            break
        least = r["least"]
    return least


def vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    """Tables of fixed size from the counts: at most ``FREQUENT`` words and ``ENDINGS`` endings come to the driver."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    named = counts.select(F.col("word").cast("binary").alias("word"), "c")
    first = named.orderBy(F.desc("c"), "word").limit(N_HEAD - 1).collect()  # head words there are, also where too many words have one count for a table of them
    frequent = named.where(F.col("c") >= _least_count(counts)).collect()
    top = sorted({(bytes(r["word"]), r["c"]) for r in [*first, *frequent]}, key=lambda r: (-r[1], r[0]))
    spark = counts.sparkSession
    head = spark.createDataFrame([(bytearray(w),) for w, _ in top[: N_HEAD - 1]], "head binary")
    rest = named.join(F.broadcast(head), F.col("word") == F.col("head"), "left_anti")  # fewer than N_HEAD rows
    by_ending = rest.groupBy(F.substring("word", -ENDING, ENDING).alias("ending")).agg(F.sum("c").alias("c"), F.count("*").alias("n"))
    by_ending = stage(by_ending, "endings")
    common = by_ending.orderBy(F.desc("c"), "ending").limit(ENDINGS).collect()
    endings = {bytes(r["ending"]): k for k, r in enumerate(common)}
    tokens, kinds = np.zeros(ENDINGS + HASHED, np.int64), np.zeros(ENDINGS + HASHED, np.int64)
    for k, r in enumerate(common):
        tokens[k], kinds[k] = r["c"], r["n"]
    taken = spark.createDataFrame([(bytearray(e),) for e in endings] or [(bytearray(b"\0"),)], "taken binary")
    others = by_ending.join(F.broadcast(taken), F.col("ending") == F.col("taken"), "left_anti")  # ENDINGS rows
    for r in others.groupBy((F.crc32("ending") % HASHED).alias("k")).agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect():
        tokens[ENDINGS + r["k"]], kinds[ENDINGS + r["k"]] = r["c"], r["n"]
    return Vocabulary(
        {w: k for k, (w, _) in enumerate(top)}, np.array([c for _, c in top], np.int64), len(top), endings,
        tokens, kinds, int(sums[0]) + n_docs, int(sums[1]) + bool(n_docs), n_docs,
    )


@dataclass(frozen=True)
class Numbered:
    """Texts one after another, each with its end: positions in the tables of ``Numbering`` (-1: other words), tokens, and lengths; the other words in order."""

    at: np.ndarray
    tokens: np.ndarray
    lengths: np.ndarray
    others: pa.Array


class Numbering:
    """Texts as token numbers, with what counts are known here and which words have to be looked up elsewhere.

    Tables hold the end (0), the head words (their token numbers) and the other frequent words (``N_HEAD`` + position).
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.words = pa.array(list(vocabulary.frequent), pa.large_binary()).cast(pa.large_string())
        place = np.fromiter(vocabulary.frequent.values(), np.int64, vocabulary.n_words)
        self.places = np.append(np.where(place + 1 < N_HEAD, place + 1, N_HEAD + place), -1)  # the last one is of words that are not there
        n = N_HEAD + vocabulary.n_words
        self.token, self.in_class = np.zeros(n, np.int64), np.zeros(n)
        self.log_count = np.zeros(n)
        self.log_count[0] = np.log10(vocabulary.ends + 1)
        self.class_size = np.log10(vocabulary.class_tokens + vocabulary.class_words + 1.0)
        for (word, k), at in zip(vocabulary.frequent.items(), self.places.tolist()):
            self.log_count[at] = np.log10(vocabulary.counts[k] + 1)
            if at < N_HEAD:
                self.token[at] = at
            else:
                c = vocabulary.class_of(word)
                self.token[at] = N_HEAD + c
                self.in_class[at] = self.log_count[at] - self.class_size[c]
        self.base = np.log10(vocabulary.total + vocabulary.distinct + 1.0)

    def numbered(self, texts: pa.Array) -> Numbered:
        words, n_words = _split(texts)
        found = pc.index_in(words, value_set=self.words)
        places = self.places[pc.fill_null(found, -1).to_numpy()]
        others = words.filter(pc.is_null(found))
        lengths = n_words + 1
        at = np.zeros(len(words) + len(lengths), np.int64)
        is_word = np.ones(len(at), bool)
        is_word[np.cumsum(lengths) - 1] = False
        at[is_word] = places
        tokens = self.token[at]
        endings = pc.binary_slice(others.cast(pa.large_binary()), -ENDING).dictionary_encode()
        classes = np.array([self.v.class_of(e) for e in endings.dictionary.to_pylist()], np.int64)
        tokens[at < 0] = N_HEAD + classes[endings.indices.to_numpy()]
        return Numbered(at, tokens, lengths, others)

    def scores(self, x: Numbered) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: known tokens, the base score and the part of the model's score inside classes, both without the counts of the other words."""
        known, firsts = x.at >= 0, np.cumsum(x.lengths) - x.lengths
        log_count, in_class = np.where(known, self.log_count[x.at], 0), np.where(known, self.in_class[x.at], 0)
        in_class[~known] = -self.class_size[x.tokens[~known] - N_HEAD]
        base = np.add.reduceat(log_count, firsts) - x.lengths * self.base
        return np.add.reduceat(known, firsts, dtype=np.int64) - (not self.v.ends), base, np.add.reduceat(in_class, firsts)


def _round(doc_id: Column, text: Column) -> Column:
    """The round that trains on a document, from 0. By id and text, so that rows without an id are spread as well."""
    return F.floor(share(doc_id, text, F.lit("language model")) * len(ROUNDS))


def _training_rounds(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Parameters after all rounds, which take every document once; each trains every partition's part of its slice from the same start and averages."""
    spark, shape = docs.sparkSession, vocabulary.shape
    head_counts = np.zeros(N_HEAD)
    head_counts[0] = vocabulary.ends
    for k in range(min(vocabulary.n_words, N_HEAD - 1)):
        head_counts[k + 1] = vocabulary.counts[k]
    flat = recurrent.initial(shape, np.concatenate([head_counts, vocabulary.class_tokens]))
    shared_vocabulary = spark.sparkContext.broadcast(vocabulary)
    for number, rate in enumerate(ROUNDS):
        part = docs.where(_round(F.col("doc_id"), F.col("text")) == number).select("text")
        shared = spark.sparkContext.broadcast(flat)

        def train(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            numbering, weight, own = None, 0, shared.value
            for batch in batches:
                numbering = numbering or Numbering(shared_vocabulary.value)
                for low in range(0, len(batch), SLICE):
                    stream = np.concatenate([np.zeros(1, np.int64), numbering.numbered(batch.column(0)[low : low + SLICE]).tokens])
                    own = recurrent.train_on(shape, own, stream, rate)
                    weight += len(stream) - 1
            if weight:
                arrays = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([(own.astype(np.float64) * weight).tobytes()]), pa.array([float(weight)])]
                yield pa.RecordBatch.from_arrays(arrays, ["k", "x", "w"])

        flat = _weighted_mean(part.mapInArrow(train, SUMS), flat)
    return flat


SUMS = "k int, x binary, w double"


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for all of them, added in the order of ``k``."""
    frame = frame.sort_values("k")
    total = np.sum([np.frombuffer(x) for x in frame.x], axis=0)
    return pd.DataFrame({"k": [int(frame.k.iloc[0]) // FAN_IN], "x": [total.tobytes()], "w": [frame.w.sum()]})


def _weighted_mean(sums: DataFrame, otherwise: np.ndarray) -> np.ndarray:
    """Sum of ``x`` over sum of ``w``, as a tree: each task adds at most ``FAN_IN`` arrays, one level after the other.

    The driver gets one array for each ``FAN_IN`` ** 2 partitions. ``otherwise`` where there are no rows.
    """
    for _ in range(2):
        sums = sums.groupBy(F.floor(F.col("k") / FAN_IN).alias("group")).applyInPandas(_added, SUMS)
    got = sums.toPandas()
    return (np.frombuffer(_added(got).x[0]) / got.w.sum()).astype(np.float32) if len(got) else otherwise


SCORES = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("model", T.DoubleType()),
    T.StructField("others", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.IntegerType())]))),
])


def _counted(others: pa.Array, rows: np.ndarray, n_rows: int) -> pa.Array:
    """For each row the list of its words with their numbers."""
    kinds = others.dictionary_encode()
    found, n = np.unique(rows * len(kinds.dictionary) + kinds.indices.to_numpy(), return_counts=True)
    row, kind = np.divmod(found, max(len(kinds.dictionary), 1))
    bounds = np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)
    pairs = [kinds.dictionary.take(pa.array(kind)).cast(pa.string()), pa.array(n, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(pairs, ["word", "n"]))


def _first_pass(rows: DataFrame, vocabulary: Vocabulary, flat: np.ndarray) -> DataFrame:
    """(doc_id, training) with the part of both scores that needs no join, and the words that are left for it."""
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary, flat))
    schema = T.StructType([rows.schema["doc_id"], rows.schema["training"], *SCORES])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering = scorer = None
        for part in (b[k : k + SLICE] for b in batches for k in range(0, len(b), SLICE)):
            if numbering is None:
                v, parameters = shared.value
                numbering, scorer = Numbering(v), recurrent.Scorer(v.shape, parameters)
            x = numbering.numbered(part.column("text"))
            n_known, base, model = numbering.scores(x)
            model += scorer.score_joined(x.tokens, x.lengths) / LN10
            others = _counted(x.others, np.repeat(np.arange(len(x.lengths)), x.lengths)[x.at < 0], len(x.lengths))
            arrays = [part.column("doc_id"), part.column("training"), pa.array(x.lengths, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(model), others]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return rows.select("doc_id", "training", "text").mapInArrow(score, schema)


def scored(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``training`` marks the rows to learn from. Null and empty texts are the end token alone.
    Repeated rows repeat, and count in training each. Without training rows every count is 0 and
    the network gives all classes alike. No rows give none; further columns are ignored.
    """
    rows = docs.select("doc_id", "text", training.alias("training"))
    learnt = rows.where("training")
    counts = stage(word_counts(learnt), "word-counts")
    v = vocabulary(counts, learnt.count())
    flat = _training_rounds(learnt, v)
    first = stage(_first_pass(rows, v, flat).withColumn("row", F.monotonically_increasing_id()), "first-pass")
    left = first.select("row", F.explode("others").alias("o")).select("row", F.xxhash64("o.word").alias("h"), "o.n")
    looked_up = spread(left, "h").join(counts.select("h", "c"), "h")
    extra = looked_up.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log_counts"))
    joined = first.drop("others").join(extra, "row", "left")
    log_counts = F.coalesce("log_counts", F.lit(0.0))
    return joined.select(
        "doc_id", "training", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + log_counts).alias("base_score"), (F.col("model") + log_counts).alias("score"),
    )
