"""One-to-one links in document order.

The rule: people of the earlier snapshot, in order, each take the best free person of the later
one - highest score, then lowest position. People with one key (a name, or a single identity)
form a queue on each side, so a key held by very many people is two queues and one edge.

Round by round, a queue pair is settled when each side is the other's next choice. It may then
link a whole run: up to the position where another queue could take from the same people
(``next_rival``), and up to where an equally good queue has a lower position (``next_equal``).
Every such link is final. Groups with few open rows are then finished in one pass each, over arrays
of numbers; where edges outnumber people by far, a caller has this done without a round before.

The other groups go on with choices: all open people choose at once, each the best place that the
earlier people left free by their last choices, until no choice changes. A choice depends on earlier
people only, so what does not change is the rule's result. A round settles whatever depends on
settled choices alone, in whole queues, so rounds grow with the longest chain of people who displace
each other, not with the number of people who compete for one name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.operators.ordered import grouped_rank, running_sum
from rosterlens.operators.skew import detach
from rosterlens.session import drop, stage

ROUNDS_BEFORE_FINISH = 1
# About 100 bytes a row in the task that finishes a group.
SMALL_GROUP_ROWS = 5_000_000
EDGE, BEFORE, AFTER = 0, 1, 2


def _codes(first: list[pa.Array], second: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Both columns with their values as numbers from 0."""
    n = sum(map(len, first))
    codes = pa.concat_arrays([*first, *second]).dictionary_encode().indices.to_numpy()
    return codes[:n], codes[n:]


def _starts(codes: np.ndarray, size: int) -> np.ndarray:
    """Where the rows of each code begin in rows sorted by code, and the end."""
    return np.searchsorted(codes, np.arange(size + 1))


def _rule(edges: tuple, before: tuple, after: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Positions (b, a) that the rule links: edges as (v, w, score), people as (v, position) and (w, position), with v and w as numbers from 0."""
    (e_v, e_w, e_score), (b_v, b_at), (a_w, a_at) = edges, before, after
    sizes = [int(max((x.max() for x in (p, q) if len(x)), default=-1)) + 1 for p, q in ((e_v, b_v), (e_w, a_w))]
    order = np.lexsort((a_at, a_w))
    seats, turns = a_at[order], _starts(a_w[order], sizes[1])
    some = turns[e_w] < turns[e_w + 1]
    e_v, e_w, e_score = e_v[some], e_w[some], e_score[some]
    heads = seats[turns[e_w]]
    order = np.lexsort((heads, -e_score, e_v))
    low = _starts(e_v[order], sizes[0]).tolist()
    high = low[1:]
    queue, score, head, seat = (memoryview(np.ascontiguousarray(x)) for x in (e_w[order], e_score[order], heads[order], seats))
    end = turns[1:].tolist()
    turn = turns[:-1].tolist()
    links = []
    people = np.argsort(b_at, kind="stable")
    for v, b in zip(b_v[people].tolist(), b_at[people].tolist()):
        first, last = low[v], high[v]
        while first < last and turn[queue[first]] == end[queue[first]]:
            first += 1
        low[v] = first
        best, best_score, best_seat = -1, 0.0, 0
        for k in range(first, last):
            # Queues only move on, so a queue's head at the start bounds its head now.
            if best >= 0 and (score[k] < best_score or head[k] >= best_seat):
                break
            w = queue[k]
            if turn[w] < end[w] and (best < 0 or seat[turn[w]] < best_seat):
                best, best_score, best_seat = w, score[k], seat[turn[w]]
        if best >= 0:
            turn[best] += 1
            links.append((b, best_seat))
    found = np.array(links, dtype="int64").reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _finish_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rule itself, on one small group of (kind, v, w, ord, score) rows, which are kept as arrays of numbers."""
    edges, before, after, head = ([], [], []), ([], []), ([], []), None
    for batch in batches:
        if not batch.num_rows:
            continue
        head = head or batch.slice(0, 1)
        for kind, columns, into in ((EDGE, ("v", "w", "score"), edges), (BEFORE, ("v", "ord"), before), (AFTER, ("w", "ord"), after)):
            part = batch.filter(pa.array(batch.column("kind").to_numpy() == kind))
            for c, parts in zip(columns, into):
                parts.append(part.column(c))
    if head is None:
        return
    (e_v, b_v), (e_w, a_w) = _codes(edges[0], before[0]), _codes(edges[1], after[0])
    score, b_at, a_at = (pa.concat_arrays(x).to_numpy(zero_copy_only=False) for x in (edges[2], before[1], after[1]))
    for parts in (*edges, *before, *after):
        parts.clear()
    b, a = _rule((e_v, e_w, score), (b_v, b_at), (a_w, a_at))
    group = [c for c in head.schema.names if c not in ("kind", "v", "w", "ord", "score")]
    same = pa.array(np.zeros(len(b), dtype="int64"))
    yield pa.RecordBatch.from_arrays([*[head.column(c).take(same) for c in group], pa.array(b), pa.array(a)], names=[*group, "b", "a"])


def _finish_small(edges: DataFrame, before: DataFrame, after: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Links of the small groups, and those groups."""
    rows = (
        edges.withColumn("kind", F.lit(EDGE))
        .unionByName(before.select(*group, "v", F.col("b").alias("ord"), F.lit(BEFORE).alias("kind")), allowMissingColumns=True)
        .unionByName(after.select(*group, "w", F.col("a").alias("ord"), F.lit(AFTER).alias("kind")), allowMissingColumns=True)
    )
    small = rows.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") <= SMALL_GROUP_ROWS).select(*group)
    small = stage(small, "small-groups")
    kept = rows.join(small, group, "left_semi").select(*group, "kind", "v", "w", "ord", "score")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.select(*group).schema)
    return kept.groupBy(*group).applyInArrow(_finish_in_order, f"{fields}, b bigint, a bigint"), small


def _settle_round(edges: DataFrame, before: DataFrame, after: DataFrame, group: list[str]) -> DataFrame:
    """All links that are certain now: (group, v, w, b, a)."""
    v_key, w_key = [*group, "v"], [*group, "w"]
    v_head = before.groupBy(*v_key).agg(F.min("b").alias("vb"), F.min("rank").alias("vr"))
    w_head = after.groupBy(*w_key).agg(F.min("a").alias("wa"), F.min("rank").alias("wr"))
    state = edges.hint("merge").join(v_head, v_key).hint("merge").join(w_head, w_key)
    choice = Window.partitionBy(*v_key).orderBy(F.desc("score"), "wa")
    turn = Window.partitionBy(*w_key).orderBy("vb")
    next_equal = F.when(F.lead("score").over(choice) == F.col("score"), F.lead("wa").over(choice))
    picks = (
        state.withColumn("_choice", F.row_number().over(choice))
        .withColumn("next_equal", next_equal)
        .withColumn("_turn", F.row_number().over(turn))
        .withColumn("next_rival", F.lead("vb").over(turn))
        .where("_choice = 1 and _turn = 1")
        .select(*group, "v", "w", "vr", "wr", "next_equal", "next_rival")
    )
    takers = before.hint("merge").join(picks, v_key).where("next_rival is null or b < next_rival")
    taken = after.hint("merge").join(picks, w_key).where("next_equal is null or a < next_equal")
    place = [*group, "v", "w", "place"]
    return (
        takers.select(*group, "v", "w", "b", (F.col("rank") - F.col("vr")).alias("place")).hint("merge")
        .join(taken.select(*group, "v", "w", "a", (F.col("rank") - F.col("wr")).alias("place")), place)
        .drop("place")
    )


def _choose(options: DataFrame, chosen: DataFrame, seats: DataFrame, group: list[str]) -> DataFrame:
    """Everyone's best seat (person, w, a) among those that ``chosen`` leaves free of earlier people."""
    person = [*group, "b", "v", "rank"]
    asks = options.withColumn("_held", F.lit(0))
    holds = chosen.select(*person, "w").withColumn("_held", F.lit(1))
    # A person's own choice stands behind its question, so only earlier people count.
    both = asks.unionByName(holds, allowMissingColumns=True)
    counted = running_sum(both, [*group, "w"], ["b", "v", "rank", "_held"], F.col("_held"), "_taken").where("_held = 0")
    offers = counted.withColumn("seat", F.col("_taken") + 1).hint("merge").join(seats, [*group, "w", "seat"])
    best = offers.groupBy(*person).agg(F.max_by(F.struct("w", "a"), F.struct(F.col("score"), -F.col("a"))).alias("_best"))
    return best.select(*person, "_best.w", "_best.a")


def _settle_by_choices(edges: DataFrame, before: DataFrame, after: DataFrame, group: list[str]) -> DataFrame:
    """Links (group, b, a) of open groups of any size."""
    person = [*group, "b", "v", "rank"]
    options = stage(before.hint("merge").join(detach(edges), [*group, "v"]).select(*person, "w", "score"), "options")
    seats = stage(grouped_rank(after, [*group, "w"], ["a", "rank"], "seat").select(*group, "w", "seat", "a"), "seats")
    chosen = options.select(*person, "w").limit(0)
    now, done = options, []
    while True:
        last, chosen = chosen, stage(_choose(now, chosen, seats, group), "choices")
        old = last.select(*person, F.col("w").alias("_old"))
        moved = chosen.join(old, person, "full_outer").where(~F.col("w").eqNullSafe(F.col("_old"))).select(*group).distinct()
        moved = stage(moved, "moved")
        done.append(chosen.join(moved, group, "left_anti").select(*group, "b", "a"))
        if moved.isEmpty():
            break
        now, chosen = options.join(moved, group, "left_semi"), chosen.join(moved, group, "left_semi")
    return stage(_all(done), "links")


def _all(tables: list[DataFrame]) -> DataFrame:
    result = tables[0]
    for more in tables[1:]:
        result = result.unionByName(more)
    return result


def link_in_order(
    edges: DataFrame, before: DataFrame, after: DataFrame, group: list[str],
    rounds_before_finish: int = ROUNDS_BEFORE_FINISH,
) -> DataFrame:
    """Links (group, b, a) from edges (group, v, w, score), before (group, v, b) and after (group, w, a).

    Without ``rounds_before_finish``, small groups are finished at once: right where edges outnumber the people by far.
    """
    v_key, w_key = [*group, "v"], [*group, "w"]
    edges = stage(edges.select(*group, "v", "w", "score"), "edges")
    found: list[DataFrame] = []
    if not rounds_before_finish:
        links, small = _finish_small(edges, before, after, group)
        found.append(stage(links, "links"))
        edges = stage(edges.join(small, group, "left_anti"), "edges")
    if edges.isEmpty():
        return _all(found) if found else before.select(*group, "b", F.lit(0).cast("bigint").alias("a")).limit(0)
    # Tables of people and edges are sorted for joins: packed in files they look small enough to be sent to all through the driver.
    before = before.join(detach(edges.select(*v_key).distinct()).hint("merge"), v_key, "left_semi").select(*v_key, "b")
    after = after.join(detach(edges.select(*w_key).distinct()).hint("merge"), w_key, "left_semi").select(*w_key, "a")
    before = stage(grouped_rank(before, v_key, "b"), "before")
    after = stage(grouped_rank(after, w_key, "a"), "after")
    round_no = 0
    while not edges.isEmpty():
        round_no += 1
        last = (edges, before, after)
        if round_no > max(rounds_before_finish, 1):
            links, small = _finish_small(edges, before, after, group)
            found.append(stage(links, "links"))
            edges = stage(edges.join(small, group, "left_anti"), "edges")
            if edges.isEmpty():
                break
            before, after = (t.join(small, group, "left_anti") for t in (before, after))
            found.append(_settle_by_choices(edges, before, after, group))
            break
        links = stage(_settle_round(edges, before, after, group), "links")
        found.append(links.select(*group, "b", "a"))
        before = before.join(links.select(*group, "b").hint("merge"), [*group, "b"], "left_anti")
        after = after.join(links.select(*group, "a").hint("merge"), [*group, "a"], "left_anti")
        edges = stage(
            edges.join(before.select(*v_key).distinct().hint("merge"), v_key, "left_semi")
            .join(after.select(*w_key).distinct().hint("merge"), w_key, "left_semi"),
            "edges",
        )
        before = stage(before.join(detach(edges.select(*v_key).distinct()).hint("merge"), v_key, "left_semi"), "before")
        after = stage(after.join(detach(edges.select(*w_key).distinct()).hint("merge"), w_key, "left_semi"), "after")
        for table in last:
            drop(table)
    return _all(found)
