"""Token counts by a two-tier lookup of pre-token lengths, without a pre-token shuffle.

A byte-level BPE splits a text into pre-tokens and encodes each on its own, so a text has as many
tokens as its pre-tokens have together. The lengths of the frequent ones are encoded once and
broadcast; each worker encodes what misses that table and caches it, by the ranks of the file's own
merges where these are in order, else with the library. Which
pre-tokens are frequent is found by mergeable sketches over all texts, in groups of input
partitions: only the sketches are moved. The table has a fixed size and only saves time - counts
are the same whatever is in it.

The split repeats the library's in an own expression. Texts with characters that Python's Unicode
tables do not know (the library's may) and texts with the string of an added token go to the
library whole.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

FREQUENT = 50_000
PER_GROUP = 25_000
CACHED = 300_000
LIMIT = 512
# fixed value: the split of byte-level BPE
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONGEST_CACHED = 64
FAR = re.compile("[^\x00-\u0377]").search  # below, every character has long been known; this class is much faster to search than the unknown ones
BLOCK = 1 << 20

_COUNTERS: dict[tuple[str, int], Callable[[list[str]], list[int]]] = {}


class Lengths(dict):
    """Token numbers by pre-token: the frequent ones, and a bounded cache of the others."""

    def __init__(self, encoded: Callable[[str], int], frequent: dict[str, int]) -> None:
        super().__init__(frequent)
        self.encoded, self.frequent = encoded, frequent

    def sums(self, texts: list[list[str]]) -> list[int]:
        """The tokens of texts that are split into pieces."""
        pieces = set(chain.from_iterable(texts))
        missing = pieces.difference(self)
        if len(self) + len(missing) > len(self.frequent) + CACHED:
            self.clear()
            self.update(self.frequent)
            missing = pieces.difference(self)
        self.update((p, self.encoded(p)) for p in missing)
        return [sum(map(self.__getitem__, t)) for t in texts]


def _piece_encoder(path: str, tokenizer: Tokenizer) -> Callable[[str], int]:
    """The token number of one pre-token.

    Where the file's merges make the tokens in the order of their ids, the ids rank the merges, and
    the encoder of ranked byte pairs gives the same tokens at a small part of the library's cost.
    """
    model = json.loads(Path(path).read_text())["model"]
    plain = [c for c in range(256) if chr(c).isprintable() and not chr(c).isspace() and c != 0xAD]
    shown = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ranks = {bytes(shown[c] for c in token): k for token, k in model["vocab"].items() if all(c in shown for c in token)}
    in_order = all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
    if not in_order or len([1 for k in ranks.values() if k < 256]) != 256 or model.get("ignore_merges"):
        return lambda piece: len(tokenizer.encode(piece, add_special_tokens=False).ids)
    ranked = {token: k for token, k in ranks.items() if k < 256 + len(merges)}
    single = tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranked, special_tokens={})._encode_single_piece
    return lambda piece: len(single(piece))


def _unknown_characters() -> regex.Pattern:
    """Characters without a category in Python's Unicode tables."""
    ranges, start = [], None
    for c in range(sys.maxunicode + 2):
        known = c > sys.maxunicode or unicodedata.category(chr(c)) != "Cn"
        if not known and start is None:
            start = c
        if known and start is not None:
            ranges.append((start, c - 1))
            start = None
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


def counter(path: str, frequent: dict[str, int]) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts as the library does for the file at ``path``."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if "ByteLevel" not in str(tokenizer.pre_tokenizer) or tokenizer.normalizer is not None:
        return lambda texts: [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    split, unknown, lengths = regex.compile(SPLIT).findall, _unknown_characters().search, Lengths(_piece_encoder(path, tokenizer), frequent)

    def count(texts: list[str]) -> list[int]:
        out, block, size = [0] * len(texts), [], 0
        for k, text in enumerate(texts):
            if any(a in text for a in added) or (not text.isascii() and FAR(text) and unknown(text)):
                out[k] = len(tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                block.append((k, split(text)))
                size += len(text)
            if block and (size >= BLOCK or k + 1 == len(texts)):
                for (at, _), n in zip(block, lengths.sums([pieces for _, pieces in block])):
                    out[at] = n
                block, size = [], 0
        return out

    return count


def frequent_pieces(docs: DataFrame, most: int = FREQUENT, per_group: int = PER_GROUP) -> list[str]:
    """About the ``most`` most frequent pre-tokens of all texts; at most so many."""
    groups = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = docs.select((F.spark_partition_id() % groups).alias("part"), F.explode(F.regexp_extract_all("text", F.lit(SPLIT), F.lit(0))).alias("piece"))
    tops = pieces.groupBy("part").agg(F.expr(f"approx_top_k(piece, {int(per_group)}, {2 * int(per_group)})").alias("top"))
    items = tops.select(F.explode("top").alias("t")).groupBy("t.item").agg(F.sum("t.count").alias("n"))
    return [r["item"] for r in items.where(F.length("item") <= LONGEST_CACHED).orderBy(F.desc("n"), "item").limit(most).collect()]


def with_tokens(docs: DataFrame, path: str, name: str = "n_tokens", most: int = FREQUENT) -> DataFrame:
    """Adds the token number of the column ``text``; null and empty texts have 0. ``path`` must exist on every executor."""
    spark = docs.sparkSession
    tokenizer = Tokenizer.from_file(path)
    pieces = frequent_pieces(docs, most)
    table = {p: len(e.ids) for p, e in zip(pieces, tokenizer.encode_batch(pieces, add_special_tokens=False))}
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf(T.LongType())
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = (path, shared.id if hasattr(shared, "id") else id(shared))
        for part in parts:
            count = _COUNTERS.get(key)
            if count is None:
                _COUNTERS.clear()  # one table a worker
                count = _COUNTERS[key] = counter(path, shared.value)
            yield pd.Series(count([x or "" for x in part]), dtype="int64")

    return docs.withColumn(name, tokens(F.col("text")))


def measured(docs: DataFrame, path: str, limit: int = LIMIT, most: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Null texts count as empty: no bytes, no tokens. Repeated rows repeat; no rows give none;
    further columns are ignored.
    """
    text: Column = F.coalesce("text", F.lit(""))
    counted = with_tokens(docs.select("doc_id", text.alias("text")), path, most=most)
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
