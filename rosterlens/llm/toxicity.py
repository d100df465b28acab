"""Toxicity by class-conditional Kneser-Ney models.

Two character models of words, one of toxic and one of ordinary documents, with absolute
discounting at the highest order. Both fall back to one Kneser-Ney model whose continuation counts
come from both classes (and every context gives it ``SHARED_WEIGHT`` observations beforehand), so an
expression that is rare in either class weighs the same in both, and only what a class really uses
more often tells them apart. A document's evidence is the log of the mean likelihood ratio of its words, as of a text in which one
word, wherever it stands, comes from the toxic model; a logistic curve fitted on labelled documents that the counts
have not seen turns it into a probability.

The counts are of a bounded sample of labelled documents (``per_class`` of each class, chosen by a
hash of their ids, whole texts). Words are counted in Spark, once a document, so that a text of one repeated word weighs little; the distinct words of the sample come
to the driver, where the n-gram tables are made. The tables are broadcast: their size is bounded by
the sample. Every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens.llm.text import share
from rosterlens.session import stage

PER_CLASS = 6000
CONTEXT = 5
DISCOUNT = 0.75
SHARED_WEIGHT = 50.0
THRESHOLD = 0.3
CACHED_WORDS = 300_000
LETTERS = re.compile(r"[^\W\d_]+")
START, END = "^", "$"
LONGEST_WORD = 64


def tokens(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return LETTERS.findall(text.lower()) if text else []


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of n-grams (toxic against ordinary), of unseen characters after a known context, and the curve."""

    seen: dict[str, float]
    unseen: dict[str, float]
    slope: float = 1.0
    base: float = 0.0

    def ratios(self, word: str) -> list[float]:
        """ln P(word | toxic) - ln P(word | ordinary), in parts of ``LONGEST_WORD`` letters that keep the context of the whole run."""
        line = START + word + END
        seen, unseen, total = self.seen, self.unseen, 0.0
        parts = []
        for i in range(1, len(line)):
            context = line[max(0, i - CONTEXT) : i]
            got = seen.get(context + line[i])
            total += unseen.get(context, 0.0) if got is None else got
            if i % LONGEST_WORD == 0 and i < len(line) - 2:
                parts.append(total)
                total = 0.0
        return [*parts, total]

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * evidence, -30, 30)))


def _grams(counts: dict[str, int]) -> tuple[Counter, dict[str, set]]:
    """Counts of every character after its full context (up to ``CONTEXT``), and the characters that follow a context."""
    grams: Counter = Counter()
    follow: dict[str, set] = defaultdict(set)
    for word, n in counts.items():
        line = START + word + END
        for i in range(1, len(line)):
            context = line[max(0, i - CONTEXT) : i]
            grams[context + line[i]] += n
            follow[context].add(line[i])
    return grams, follow


class SharedBackoff:
    """Kneser-Ney over the types of both classes: an order counts in how many different contexts an n-gram occurs."""

    def __init__(self, grams: set[str]) -> None:
        self.types: Counter = Counter()
        level = set(grams)
        for _ in range(CONTEXT + 1):  # an n-gram continues once for each longer n-gram that ends with it
            shorter: Counter = Counter(g[1:] for g in level if len(g) > 1)
            self.types.update(shorter)
            level = set(shorter)
        self.total: Counter = Counter()
        self.kinds: Counter = Counter()
        for gram, n in self.types.items():
            self.total[gram[:-1]] += n
            self.kinds[gram[:-1]] += 1
        self.alphabet = self.kinds[""] + 1

    def probability(self, context: str, char: str) -> float:
        below = self.probability(context[1:], char) if context else 1 / self.alphabet
        total = self.total.get(context, 0)
        if not total:
            return below
        kept = max(self.types.get(context + char, 0) - DISCOUNT, 0.0)
        return (kept + DISCOUNT * self.kinds[context] * below) / total


def train_tables(toxic: dict[str, int], ordinary: dict[str, int]) -> Model:
    """The n-gram tables of word counts by class."""
    sides = [_grams(toxic), _grams(ordinary)]
    shared = SharedBackoff(set(sides[0][0]) | set(sides[1][0]))
    totals = []
    for grams, _ in sides:
        total: Counter = Counter()
        for gram, n in grams.items():
            total[gram[:-1]] += n
        totals.append(total)

    def rest(side: int, context: str) -> float:
        """The share of the fallback in a class's model after a context."""
        kinds = len(sides[side][1][context]) if context in sides[side][1] else 0
        return (DISCOUNT * kinds + SHARED_WEIGHT) / (totals[side].get(context, 0) + SHARED_WEIGHT)

    unseen = {c: math.log(rest(0, c)) - math.log(rest(1, c)) for c in set(totals[0]) | set(totals[1])}
    seen = {}
    for gram in set(sides[0][0]) | set(sides[1][0]):
        context = gram[:-1]
        below = shared.probability(context[1:], gram[-1])
        p = [max(grams.get(gram, 0) - DISCOUNT, 0.0) / (totals[k].get(context, 0) + SHARED_WEIGHT) + rest(k, context) * below for k, (grams, _) in enumerate(sides)]
        seen[gram] = math.log(p[0]) - math.log(p[1])
    return Model(seen, unseen)


def evidence(model: Model, texts: pd.Series, cache: dict[str, list[float]]) -> np.ndarray:
    """The log of the mean likelihood ratio of each text's words, 0 for texts without any.

    Every word counts, however small its ratio; in the mean of likelihoods thousands of words that
    are a little more usual in one class (as each language is) do not outweigh the few that decide.
    A run of more than ``LONGEST_WORD`` letters counts as several words and is not cached.
    """
    out = np.zeros(len(texts))
    for k, text in enumerate(texts):
        ratios: list[float] = []
        for word in tokens(text):
            got = cache.get(word)
            if got is None:
                got = model.ratios(word)
                if len(word) <= LONGEST_WORD:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[word] = got
            ratios += got
        if ratios:
            each = np.array(ratios)
            most = each.max()
            out[k] = most + math.log(np.exp(each - most).mean())
    return out


def fit_curve(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and base of a weighted logistic curve by damped Newton steps, with a weak pull towards a slope of 0."""
    scale = float(np.std(x)) or 1.0
    z = np.column_stack([x / scale, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (toxic - p)) - np.array([1e-2, 0]) * beta
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(bend, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0] / scale), float(beta[1])


def _distinct_words(text: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def lists(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([list(set(tokens(x))) for x in part])

    return lists(text)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on documents (doc_id, text) with a label (doc_id, toxic); labels without an id or a value are left out.

    About ``per_class`` labels of each class are taken, three quarters for the counts and one for
    the curve; a document with several differing labels counts as toxic. The taken labels are few,
    so they go to the documents, which are not moved. Without rows of both classes every ratio is 0
    and the curve is the share of toxic labels, smoothed.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    sizes = {bool(r["toxic"]): r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_ordinary = sizes.get(True, 0), sizes.get(False, 0)
    prior = math.log((n_toxic + 0.5) / (n_ordinary + 0.5)) if n_toxic + n_ordinary else -4.0
    if not n_toxic or not n_ordinary:
        return Model({}, {}, 1.0, prior)
    part = F.when(F.col("toxic"), min(1.0, per_class / n_toxic)).otherwise(min(1.0, per_class / n_ordinary))
    taken = known.where(share(F.col("doc_id"), F.lit("toxicity")) < part).withColumn("for_curve", share(F.lit("curve"), F.col("doc_id")) < 0.25)
    taken = stage(taken, "taken-labels")
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id"), "labelled-sample")  # about two times per_class rows
    words = sample.where("not for_curve").select("toxic", F.explode(_distinct_words(F.col("text"))).alias("word"))
    counts = words.groupBy("word").agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("ordinary")).toPandas()
    by_class = [dict(zip(counts.word[counts[c] > 0], counts[c][counts[c] > 0].tolist())) for c in ("toxic", "ordinary")]
    model = train_tables(*by_class)
    held = sample.where("for_curve").select("toxic", _evidence(docs, model)(F.col("text")).alias("x")).toPandas()
    toxic = held.toxic.to_numpy(dtype=float)
    if len(np.unique(toxic)) < 2:
        return Model(model.seen, model.unseen, 1.0, prior)
    weight = np.where(toxic > 0, n_toxic / toxic.sum(), n_ordinary / (1 - toxic).sum()) * len(toxic) / (n_toxic + n_ordinary)
    slope, base = fit_curve(held.x.to_numpy(dtype=float), toxic, weight)
    return Model(model.seen, model.unseen, slope, base)


def _evidence(rows: DataFrame, model: Model):
    """A function of a text column: its evidence under a broadcast model."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def mean_ratio(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, list[float]] = {}
        for part in parts:
            yield pd.Series(evidence(shared.value, part, cache))

    return mean_ratio


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Adds the probability (0 to 1) that a text is toxic; null texts and texts without words get the one of no evidence."""
    x = _evidence(docs, model)(F.col("text"))
    inner = F.lit(model.base) + F.lit(model.slope) * x
    return docs.withColumn(name, 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), inner)))))


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, with all their columns. No rows give none."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    return with_score(rows, model, "toxicity").where(F.col("toxicity") < threshold).select("row.*")
