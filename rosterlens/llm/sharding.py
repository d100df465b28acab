"""Sharding: longest-processing-time scheduling of groups that stay together.

Documents of equal text are one group, which weighs as much as all its documents. Groups are taken
from the heaviest to the lightest, and each goes to the least-loaded shard, which a heap holds
(equal loads: the smaller shard number; equal weights: the smaller SHA-256 of the text).

One group after another is a walk for one machine, but groups of one weight are alike: once the
shards that take part lie within one weight of each other, they take turns. So the heap works
through *classes* (weight, number of groups): few groups one by one, many as runs of turns. A class
becomes a list of runs, and a group finds its shard by its rank inside its class. The result is
that of the plain walk.

The driver sees one row for each distinct weight. Distinct weights add up to no more than all
bytes, so there are at most sqrt(2 x bytes): 14 million numbers for 100 TB, whatever the rows are.
Groups, ranks and slots never leave Spark. Ranks and slots come from ranges of rows
(``ordered.grouped_rank``), so that a class or a shard of any size is many tasks.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.operators.ordered import grouped_rank
from rosterlens.operators.skew import detach
from rosterlens.session import stage

SHARDS = 8


def _turns_before(load: int, shard: int, weight: int, rival: tuple[int, int]) -> int:
    """How many times ``shard`` takes a group of ``weight`` before the rival is less loaded."""
    whole, rest = divmod(rival[0] - load, weight)
    return whole + (rest > 0 or shard < rival[1])


def schedule(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[tuple[int, list[int]]]]]:
    """(weight, runs) of every class (weight > 0, count), which come in descending order of weight.

    A run (start, turns) places the groups of ranks ``start``, ``start`` + 1, ... of the class on
    the shards in ``turns``, over and over, until the next run starts.
    """
    heap = [(0, shard) for shard in range(shards)]
    for weight, count in classes:
        runs, placed = [], 0
        while count - placed >= 2 * shards:
            order = sorted(heap)
            taking = bisect_left(order, (order[0][0] + weight, order[0][1]))
            turns = count - placed
            if taking < shards:
                turns = min(turns, sum(_turns_before(load, shard, weight, order[taking]) for load, shard in order[:taking]))
            runs.append((placed, [shard for _, shard in order[:taking]]))
            rounds, more = divmod(turns, taking)
            heap = [(load + (rounds + (i < more)) * weight, shard) if i < taking else (load, shard) for i, (load, shard) in enumerate(order)]
            placed += turns
        heapq.heapify(heap)
        if placed < count:
            last = []
            for _ in range(count - placed):
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + weight, shard))
                last.append(shard)
            runs.append((placed, last))
        yield weight, runs


def _planned(groups: DataFrame, shards: int) -> DataFrame:
    """(weight, runs) of the classes of ``groups``, as a written table."""
    classes = groups.groupBy("weight").agg(F.count("*").alias("count")).toArrow()
    pairs = sorted(zip(classes["weight"].to_pylist(), classes["count"].to_pylist(), strict=True), reverse=True)
    runs = pa.list_(pa.struct([("start", pa.int64()), ("turns", pa.list_(pa.int32()))]))
    planned = list(schedule(pairs, shards))
    plan = pa.table({
        "weight": pa.array([weight for weight, _ in planned], pa.int64()),
        "runs": pa.array([[{"start": s, "turns": t} for s, t in r] for _, r in planned], runs),
    })
    return stage(groups.sparkSession.createDataFrame(plan), "plan")


def assign(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(key, shard) of rows (key, weight) with one row a key and positive whole weights. No rows give no rows."""
    ranked = grouped_rank(groups.select("key", "weight"), ["weight"], ["key"])
    place = F.col("rank") - 1
    run = F.element_at(F.filter("runs", lambda r: r["start"] <= place), -1)
    turn = ((place - run["start"]) % F.size(run["turns"])).cast("int")
    return ranked.join(detach(_planned(groups, shards)), "weight").select("key", F.get(run["turns"], turn).alias("shard"))


def text_key(text: Column) -> Column:
    """SHA-256 of a text: equal keys are equal texts. Null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and one more, so that no document weighs nothing."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _weighed(rows: DataFrame) -> DataFrame:
    """(key, weight) of the groups of rows (key, size). Counts are combined before the shuffle, so a hot text is one row a task."""
    return stage(rows.groupBy("key").agg(F.sum("size").alias("weight")), "groups")


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row (doc_id, text).

    Equal texts share a shard; a null text counts as an empty one (size 1, checksum 0). ``slot``
    numbers the rows of a shard from 0 by ``doc_id``, null ids first; repeated rows have slots of
    their own, in any order. No rows give no rows; a shard may stay empty; further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", text_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        text_key(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows, "sized")
    homes = stage(assign(_weighed(rows), shards), "homes")
    housed = rows.join(detach(homes), "key").drop("key")
    return grouped_rank(housed, ["shard"], ["doc_id", "row"], "slot").select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))


def with_shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All rows and columns of ``docs`` with the ``shard`` of each text; an own column ``shard`` is replaced. Cases as in ``placed``."""
    keyed = docs.drop("shard").select(F.struct("*").alias("doc"), text_key(F.col("text")).alias("key"), text_size(F.col("text")).alias("size"))
    homes = stage(assign(_weighed(keyed), shards), "homes")
    return keyed.join(detach(homes), "key").select("doc.*", "shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, rows_per_file: int = 1_000_000) -> None:
    """Write whole documents below ``path/shard=N``; a shard has as many files, and tasks that write them, as its rows need."""
    housed = stage(with_shard(docs, shards), "housed")
    sizes = housed.groupBy("shard").agg(F.ceil(F.count("*") / rows_per_file).alias("_files"))
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.col("_files"))
    out = housed.join(F.broadcast(sizes), "shard").repartition("shard", spread).drop("_files")
    out.write.mode("overwrite").partitionBy("shard").parquet(path)
