"""Language identification from averaged hashed subword embeddings.

A text is the average of the embeddings of its character n-grams (hashed to a fixed number of
buckets), followed by a linear softmax. Embeddings and weights are trained together by stochastic
gradient descent in numpy, on a bounded sample of labelled documents. A temperature, fitted on
documents that the training left out, calibrates the probabilities.

A softmax only says which learnt language is the likeliest, not whether it is one of them. So a
text is also measured by how usual its n-grams are: the mean of ln P(bucket) under the language
that uses the bucket most, in standard errors from the mean of the left-out documents (the error
grows for texts with few different n-grams). A text is rejected ``MARGIN`` times as far below
it as all but ``REJECTED_SHARE`` of those documents are, at least ``LEAST_ERRORS`` standard errors; or where its calibrated probability
is below ``LEAST_PROBABILITY`` and below all but that share of them. Text that mixes learnt languages is usual; other languages and random letters are not.

As average and softmax are both linear, embeddings times weights make one table of bucket scores;
prediction is a gather and a sum over the n-grams of the whole text, in pieces of bounded size. The
table (buckets x languages) is broadcast; it does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens.llm.text import share

SAMPLE = 3000
PER_LANGUAGE = 50
LANGUAGES = 250
BUCKETS = 1 << 14
GRAMS = (2, 3)
WIDTH = 16
PASSES = 6
BATCH = 16
RATE = 2.0
REJECTED_SHARE = 0.0005
MARGIN = 4.0
LEAST_ERRORS = 8.0
SMOOTHING = 200.0
LEAST_PROBABILITY = 0.2
PIECE = 1 << 19
UNDETERMINED = "und"
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


_LETTER: np.ndarray | None = None


def _letters(codes: np.ndarray) -> np.ndarray:
    """Code points of letters; 0 for everything else."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(_LETTER[codes], codes, 0).astype(np.uint64)


def buckets_of(text: str) -> Iterator[np.ndarray]:
    """The bucket numbers of a text's n-grams, piece by piece. Runs without letters separate words; n-grams reach into the gap."""
    codes = _code_points(text)
    longest = max(GRAMS)
    for low in range(0, max(len(codes), 1), PIECE):
        part = _letters(codes[max(0, low - longest + 1) : low + PIECE])
        if not low:
            part = np.concatenate([np.zeros(1, np.uint64), part])
        if low + PIECE >= len(codes):
            part = np.concatenate([part, np.zeros(1, np.uint64)])
        keep = np.ones(len(part), bool)
        keep[1:] = (part[1:] > 0) | (part[:-1] > 0)  # one gap for a run of separators
        part = part[keep]
        for n in GRAMS:
            if len(part) < n:
                continue
            h = np.full(len(part) - n + 1, n, np.uint64)
            some = np.zeros(len(h), bool)
            for k in range(n):
                piece = part[k : len(part) - n + 1 + k]
                h = (h ^ piece) * _SEED
                some |= piece > 0
            yield (h >> np.uint64(64 - BUCKETS.bit_length() + 1))[some].astype(np.int32)


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for part in buckets_of(text):
        total += np.bincount(part, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


@dataclass(frozen=True)
class Usual:
    """How usual the n-grams of learnt documents are: ln P of every bucket, the mean over documents, and its error within and between them."""

    of_bucket: np.ndarray
    mean: float
    within: float
    between: float
    least: float = -LEAST_ERRORS

    def errors(self, total: float, n: int, distinct: int) -> float:
        """By how many standard errors ``n`` n-grams, whose ln P add up to ``total``, differ from the mean. Repeats tell nothing new, so the error is one of the distinct ones."""
        return (total / n - self.mean) / float(np.sqrt(self.within**2 / distinct + self.between**2))


@dataclass(frozen=True)
class Model:
    """Languages, the score of every bucket for each, the bias, the probability below which a text is rejected, and what is usual."""

    languages: tuple[str, ...]
    scores: np.ndarray
    bias: np.ndarray
    least: float
    usual: Usual

    def judge(self, text: str) -> tuple[np.ndarray, float] | None:
        """Calibrated probabilities, and how usual the text is in standard errors; None for a text without letters."""
        total, n, usual, seen = np.zeros(len(self.languages)), 0, 0.0, np.zeros(BUCKETS, bool)
        for part in buckets_of(text):
            total += np.bincount(part, minlength=BUCKETS) @ self.scores if len(part) > BUCKETS else self.scores[part].sum(axis=0, dtype=np.float64)
            usual += float(self.usual.of_bucket[part].sum(dtype=np.float64))
            seen[part] = True
            n += len(part)
        if not n:
            return None
        return softmax(total / n + self.bias), self.usual.errors(usual, n, int(np.count_nonzero(seen)))

    def rejects(self, probability: float, errors: float) -> bool:
        return probability < self.least or errors < self.usual.least


def learn_usual(buckets: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, trained: np.ndarray, check: np.ndarray) -> Usual:
    """Bucket probabilities from the rows ``trained``, their spread from the rows ``check``."""
    table = np.zeros((int(y.max()) + 1, BUCKETS))
    for k in trained:
        table[y[k], buckets[k]] += counts[k]
    shared = table.sum(axis=0) + 0.5
    shared /= shared.sum()
    of_bucket = np.log(((table + SMOOTHING * shared) / (table.sum(axis=1, keepdims=True) + SMOOTHING)).max(axis=0))
    means, spreads, sizes = (np.empty(len(check)) for _ in range(3))
    for i, k in enumerate(check):
        x, w = of_bucket[buckets[k]], counts[k] / counts[k].sum()
        means[i], sizes[i] = w @ x, len(x)
        spreads[i] = w @ (x - means[i]) ** 2
    long = sizes >= min(100, np.median(sizes))
    within = max(float(np.sqrt(spreads.mean())), 0.1)
    own = Usual(of_bucket.astype(np.float32), float(means[long].mean()), within, max(float(means[long].std()), 0.05))
    reached = [own.errors(m, 1, int(n)) for m, n in zip(means, sizes)]
    return Usual(own.of_bucket, own.mean, own.within, own.between, min(-LEAST_ERRORS, MARGIN * float(np.quantile(reached, REJECTED_SHARE))))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(buckets: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, languages: tuple[str, ...], seed: int = 7) -> Model:
    """Train on bucket counts; every fifth row is kept for the temperature and the rejection bound."""
    rng = np.random.default_rng(seed)
    n = len(y)
    held = np.arange(n) % 5 == 4 if n >= 50 else np.zeros(n, bool)
    table = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    weights += rng.normal(0, 1 / WIDTH, weights.shape).astype(np.float32)
    share_of = [(c / c.sum()).astype(np.float32) for c in counts]
    trained = np.flatnonzero(~held)
    steps = PASSES * -(-len(trained) // BATCH)
    step = 0
    for _ in range(PASSES):
        rng.shuffle(trained)
        for low in range(0, len(trained), BATCH):
            rows = trained[low : low + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            at = [buckets[r] for r in rows]
            hidden = np.stack([share_of[r] @ table[a] for r, a in zip(rows, at)])
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = error @ weights.T
            weights -= rate * hidden.T @ error
            bias -= rate * error.sum(axis=0)
            for r, a, g in zip(rows, at, back):
                table[a] -= (rate * BATCH) * share_of[r][:, None] * g  # buckets of one row are distinct
    scores = table @ weights
    logits = np.stack([s @ scores[a] for s, a in zip(share_of, buckets)]) + bias
    check = held if held.any() else ~held
    heat = min((float(h) for h in np.geomspace(0.25, 8, 41)), key=lambda h: -np.log(np.maximum(softmax(logits[check] * h)[np.arange(check.sum()), y[check]], 1e-12)).mean())
    reached = softmax(logits[check] * heat).max(axis=1)
    least = min(float(np.quantile(reached, REJECTED_SHARE)), 0.5)
    usual = learn_usual(buckets, counts, y, np.flatnonzero(~held), np.flatnonzero(check))
    return Model(languages, (scores * heat).astype(np.float32), bias * heat, max(least * 0.9, LEAST_PROBABILITY), usual)


def sampled(docs: DataFrame, sample: int = SAMPLE, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> DataFrame | None:
    """(lang, text) of about ``sample`` different rows that have both, and of up to ``per_language`` rows of a rare language; None where there are none.

    Each of the ``languages`` most frequent languages has its share of ``sample``, but at least ``per_language``; never more, whatever
    repeats. Chosen are the smallest hashes of id and text, so rows without an id are told apart, and equal rows count once.
    """
    known = docs.where("lang is not null and text is not null").select("lang", "text", share(F.col("doc_id"), F.col("text"), F.lit("language")).alias("at"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return None
    n = sum(r["n"] for r in sizes)
    quotas = [(r["lang"], max(per_language, -(-sample * r["n"] // n)), r["n"]) for r in sizes]
    wanted = docs.sparkSession.createDataFrame([(lang, q, 3.0 * q / size) for lang, q, size in quotas], "lang string, quota long, below double")
    near = known.join(F.broadcast(wanted), "lang").where("at < below").dropDuplicates(["lang", "at"])  # at most LANGUAGES rows; three times the quota is left
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    return near.withColumn("rank", rank).where("rank <= quota").select("lang", "text")


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on the ``sampled`` rows of (doc_id, text, lang); rows without letters teach nothing. None where nothing is left."""
    chosen = sampled(docs, sample)
    if chosen is None:
        return None
    schema = "lang string, buckets binary, counts binary"

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(lang, *counts_of(text)) for lang, text in zip(part.lang, part.text)]
            yield pd.DataFrame([(lang, a.tobytes(), c.tobytes()) for lang, a, c in rows if len(a)], columns=["lang", "buckets", "counts"])

    rows = chosen.mapInPandas(features, schema).toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["lang", "buckets", "counts"]).sample(frac=1, random_state=11)  # one order on every run
    languages = tuple(sorted(rows.lang.unique()))
    y = rows.lang.map({x: k for k, x in enumerate(languages)}).to_numpy()
    return fit([np.frombuffer(b, np.int32) for b in rows.buckets], [np.frombuffer(c, np.float32) for c in rows.counts], y, languages)


def with_language(docs: DataFrame, model: Model | None, name: str = "found") -> DataFrame:
    """Adds ``name`` (language, score, rejected) to rows with a column ``text``; an own column of that name is replaced.

    Null texts and texts without a letter are ``und`` with score 0 and rejected, and so is every
    text where nothing could be learnt. Repeated rows repeat with equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    @F.pandas_udf(schema)
    def identify(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for part in parts:
            rows = []
            for text in part:
                got = own.judge(text) if own and text else None
                if got is None:
                    rows.append((UNDETERMINED, 0.0, True))
                else:
                    p, errors = got
                    k = int(p.argmax())
                    rows.append((own.languages[k], float(p[k]), own.rejects(float(p[k]), errors)))
            yield pd.DataFrame(rows, columns=["language", "score", "rejected"])

    return docs.withColumn(name, identify(F.col("text")))


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that are not rejected, with all their columns, whatever these are called. Null texts and texts without letters go; repeats stay or go together."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    return with_language(rows, model).where("not found.rejected").select("row.*")
