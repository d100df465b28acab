"""Conversation prefix trie: shared beginnings of conversations, and what storing them once would save.

Turns are dictionary-encoded, conversations become rows of turn ids, and these are dealt to shards
by ranges of their order, so that the conversations below a prefix are neighbours. Each shard
grows a ternary search tree (smaller / next turn / larger) by inserting its conversations from the
median outwards, which keeps the search among siblings balanced, and then walks it without
recursion to sum up members, leaves and savings.

A prefix can cross the border between two shards only if the first or the last conversation of a
shard begins with it. These *open* nodes - two paths a shard - are merged by one pass over all
shards in order, with a stack as deep as the longest conversation; all others are final where
they are. Equal conversations are ordered by id, so a conversation that a third of all rows repeat
is spread over shards like anything else; its list of ids travels in chunks and is hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.operators.skew import detach
from rosterlens.session import stage

GROUP, MOST = 5, 9
CHUNK = 4096
NOTHING = hashlib.sha256(b"").hexdigest()

_COUNTS = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_PARTIAL = f"{_COUNTS}, shard int, place long, key string, parent_key string, parent_conv_id long, size long, ends string, kind string"
_MERGED = f"{_COUNTS}, key string, parent_key string"


def encode(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation as an array of (id, size), in the order of ``turn``.

    Null turn numbers come first, ties are ordered by role, then text. Null roles and texts count as
    empty. ``id`` stands for (role, text) in a dictionary of all distinct turns, ``size`` is the
    text's UTF-8 length. Rows without a conversation id are left out. A conversation is one row of
    the result: 16 bytes a turn must fit a task.
    """
    said = turns.where("conv_id is not null").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    numbered = stage(said.select("conv_id", F.row_number().over(order).alias("place"), digest.alias("digest"), F.octet_length("text").cast("long").alias("size")), "turns")
    dictionary = stage(numbered.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    coded = numbered.join(detach(dictionary), "digest")
    return coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "size"))).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns")
    )


def rebuilt(conversations: DataFrame, group: int = GROUP, most: int = MOST) -> DataFrame:
    """Conversations that begin with turns of the first one of their group.

    The first ``crc32(id) % most`` turns come from conversation ``id - id % group`` (all if fewer, none
    if it is absent; the remainder of a negative id is negative), the rest from the conversation itself, after as many turns of its own.
    """
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    keyed = conversations.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "head": head})
    bases = conversations.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("turns").alias("given"))
    none = F.slice("turns", 1, 0)
    own = F.slice("turns", F.col("head") + 1, F.greatest(F.size("turns") - F.col("head"), F.lit(0)))
    joined = keyed.join(bases, "base", "left")
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("given", F.lit(1), F.col("head")), none), own).alias("turns"))


class TernaryTree:
    """A ternary search tree in parallel lists. Node 0 is the textless root; 0 also means no node in the links."""

    def __init__(self) -> None:
        self.turn, self.size = [0], [0]
        self.smaller, self.next, self.larger = [0], [0], [0]

    def _add(self, turn: int, size: int) -> int:
        for column, value in ((self.turn, turn), (self.size, size), (self.smaller, 0), (self.next, 0), (self.larger, 0)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, turns: tuple[int, ...], sizes: tuple[int, ...]) -> int:
        """The node of the last turn."""
        node = 0
        for turn, size in zip(turns, sizes, strict=True):
            links, at = self.next, node
            while links[at]:
                at = links[at]
                if turn == self.turn[at]:
                    break
                links = self.smaller if turn < self.turn[at] else self.larger
            else:
                links[at] = self._add(turn, size)
                at = links[at]
            node = at
        return node

    def walk(self) -> Iterator[tuple[int, int, int]]:
        """(node, parent, depth), parents before children and siblings in ascending order."""
        yield 0, 0, 0
        todo = [(self.next[0], 0, 1, False)]
        while todo:
            node, parent, depth, smaller_done = todo.pop()
            if smaller_done:
                yield node, parent, depth
                todo.append((self.next[node], node, depth + 1, False))
            elif node:
                todo += [(self.larger[node], parent, depth, False), (node, parent, depth, True), (self.smaller[node], parent, depth, False)]


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, each range's middle before its halves."""
    todo = [(0, n)]
    while todo:
        low, high = todo.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            todo += [(middle + 1, high), (low, middle)]


def _listed(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def _path_keys(turns: tuple[int, ...]) -> list[str]:
    """Names of the prefixes of a path, the same in every shard."""
    keys = [NOTHING]
    for turn in turns:
        keys.append(hashlib.sha256(f"{keys[-1]}{turn}".encode()).hexdigest())
    return keys


def shard_nodes(shard: int, rows: list[tuple[tuple[int, ...], tuple[int, ...], int]]) -> Iterator[dict]:
    """Nodes of one shard's rows (turns, sizes, conv_id): final ones, open ones, and the ids that end in open ones."""
    rows.sort(key=lambda r: (r[0], r[2]))
    paths = [(turns, list(same)) for turns, same in groupby(rows, key=lambda r: r[0])]
    tree, ends = TernaryTree(), {}
    for i in medians(len(paths)):
        turns, same = paths[i]
        ends[tree.insert(turns, same[0][1])] = [r[2] for r in same]
    count = len(tree.turn)
    order = list(tree.walk())
    parent, depth = [0] * count, [0] * count
    members, least = [0] * count, [None] * count
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    for node, above, level in order:
        parent[node], depth[node] = above, level
    open_keys = {}
    for turns in (paths[0][0], paths[-1][0]):
        node = tree.insert(turns, (0,) * len(turns))
        for key in reversed(_path_keys(turns)):
            open_keys[node] = key
            node = parent[node]
    for node, above, _ in reversed(order):
        own = ends.get(node)
        if own:
            members[node] += len(own)
            least[node] = own[0] if least[node] is None else min(least[node], own[0])
        if node:
            members[above] += members[node]
            least[above] = least[node] if least[above] is None else min(least[above], least[node])
        if node in open_keys:
            continue  # what it adds to its parent is known when all shards are
        leaves[node] += not children[node]
        saved[node] += (members[node] - 1) * tree.size[node]
        children[above] += 1
        leaves[above] += leaves[node]
        saved[above] += saved[node]
    place = 0
    for node, above, level in order:
        row = {
            "conv_id": least[node], "depth": level, "n_convs": members[node], "n_children": children[node],
            "n_leaves": leaves[node], "saved_tokens": saved[node], "shard": shard, "place": place, "size": tree.size[node],
        }
        own = ends.get(node, [])
        if node not in open_keys:
            text = _listed(own).encode()
            inner = above not in open_keys
            yield row | {
                "kind": "final", "ends": hashlib.sha256(text).hexdigest(), "key": None,
                "parent_key": None if inner else open_keys[above], "parent_conv_id": least[above] if inner else None,
            }
            continue
        key = open_keys[node]
        yield row | {"kind": "open", "key": key, "parent_key": open_keys[above] if node else None, "parent_conv_id": None, "ends": None}
        place += 1
        for start in range(0, len(own), CHUNK):
            yield row | {"kind": "ends", "key": key, "place": start, "parent_key": None, "parent_conv_id": None, "ends": _listed(own[start : start + CHUNK])}


def _frames(rows: Iterator[dict], names: list[str], many: int = 20_000) -> Iterator[pd.DataFrame]:
    block = []
    for row in rows:
        block.append(row)
        if len(block) == many:
            yield _frame(block, names)
            block = []
    if block:
        yield _frame(block, names)


def _frame(block: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r[n] for r in block], dtype=object) for n in names})


def _grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, shard = [], 0
    for batch in batches:
        for at, conv_id, ids, sizes in zip(batch["shard"], batch["conv_id"], batch["ids"], batch["sizes"], strict=True):
            rows.append((tuple(map(int, ids)), tuple(map(int, sizes)), int(conv_id)))
            shard = int(at)
    if rows:
        yield from _frames(shard_nodes(shard, rows), _names(_PARTIAL))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def merge_open(rows: Iterator[dict]) -> Iterator[dict]:
    """Whole nodes of open ones, which come by shard and, within one, parents before children.

    The stack is the path that later shards may continue; what falls off it is complete.
    """
    stack: list[dict] = []

    def close() -> dict:
        node = stack.pop()
        node["n_leaves"] += not node["n_children"]
        node["saved_tokens"] += (node["n_convs"] - 1) * node["size"]
        if stack:
            stack[-1]["n_children"] += 1
            stack[-1]["n_leaves"] += node["n_leaves"]
            stack[-1]["saved_tokens"] += node["saved_tokens"]
        return node

    for row in rows:
        depth = row["depth"]
        if depth < len(stack) and stack[depth]["key"] == row["key"]:
            for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                stack[depth][name] += row[name]
            stack[depth]["conv_id"] = min(stack[depth]["conv_id"], row["conv_id"])
            continue
        while len(stack) > depth:
            yield close()
        stack.append(dict(row))
    while stack:
        yield close()


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = (row for batch in batches for row in batch.to_dict("records"))
    yield from _frames(merge_open(rows), _names(_MERGED))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest a key of chunks that come in order; a list of any length passes through as a stream."""
    last, state, out = None, None, []
    for batch in batches:
        for key, ends in zip(batch["key"], batch["ends"], strict=True):
            if key == last:
                state.update(b",")
            else:
                if last is not None:
                    out.append((last, state.hexdigest()))
                last, state = key, hashlib.sha256()
            state.update(ends.encode())
    if last is not None:
        out.append((last, state.hexdigest()))
    yield pd.DataFrame(out, columns=["key", "ends_sha256"])


def trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """All nodes of the trie of rows (conv_id, turns): one row for each distinct beginning, the empty one included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). Ids
    are distinct and not null; ``turns`` is an array of (id, size), null counts as empty. No rows give no
    nodes. ``shards`` is the number of ranges, by default the session's shuffle partitions; the
    result does not depend on it. A shard's conversations must fit its task.
    """
    shards = shards or int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids, sizes = (F.coalesce(F.col(f"turns.{c}"), F.array().cast("array<long>")) for c in ("id", "size"))
    ranged = stage(conversations.select("conv_id", ids.alias("ids"), sizes.alias("sizes")), "sequences").repartitionByRange(shards, "ids", "conv_id")
    partial = stage(ranged.withColumn("shard", F.spark_partition_id()).mapInPandas(_grown, _PARTIAL), "shard-nodes")
    counts = _names(_COUNTS)
    open_ = partial.where("kind = 'open'").select(*counts, "key", "parent_key", "size", "shard", "place")
    merged = stage(open_.repartition(1).sortWithinPartitions("shard", "place").drop("shard", "place").mapInPandas(_merged, _MERGED), "open-nodes")
    chunks = partial.where("kind = 'ends'").select("key", "shard", "place", "ends")
    ends = chunks.repartition("key").sortWithinPartitions("key", "shard", "place").select("key", "ends").mapInPandas(_hashed, "key string, ends_sha256 string")
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    final = partial.where("kind = 'final'").withColumnRenamed("ends", "ends_sha256")
    below = final.where("parent_key is not null").drop("parent_conv_id").join(detach(parents), "parent_key")
    crossing = merged.join(parents, "parent_key", "left").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    out: list[str | Column] = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return final.where("parent_key is null").select(*out).unionByName(below.select(*out)).unionByName(crossing.select(*out))


def conversation_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """The trie of the rebuilt conversations of rows (conv_id, turn, role, text). Repeated rows are turns of their own; further columns are ignored."""
    return trie(rebuilt(stage(encode(turns), "conversations")), shards)
