"""Chat formatting: collapse cumulative snapshots, then render.

Logs often hold one conversation many times, each snapshot with some turns more. The turns of a
conversation are numbered, and the hashes of its numbered turns summed up along it: equal sums over
equally many turns mean equal prefixes. A conversation whose whole sum is some longer one's sum at
that turn is a prefix of it; an anti-join keeps the others. Of equal conversations the one with
the smallest id stays. Only what is kept is rendered.

The sums are of two 32-bit halves, so they never overflow; a pair of sums over ten thousand turns
still has more than 64 bits of which a chance match would need all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.operators.skew import detach
from rosterlens.session import stage

HALF = 0xFFFFFFFF


def turn_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, low, high): numbered turns with the sums of their hashes so far."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").isNull(), "turn", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    numbered = turns.select("conv_id", "role", "text", F.row_number().over(order).alias("place"), "turn")
    h = F.xxhash64("place", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    along = order.rowsBetween(Window.unboundedPreceding, 0)
    return numbered.select(
        "conv_id", "place", "role", "text",
        F.sum(h.bitwiseAND(HALF)).over(along).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).over(along).alias("high"),
    )


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, snapshots) of the conversations that are not a prefix of a longer one, one of each equal group.

    ``snapshots`` counts the logged conversations of exactly these turns.
    """
    wholes = prefixes.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    ends = prefixes.join(detach(wholes), "conv_id")
    last = ends.where("place = n_turns").groupBy("place", "low", "high").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("snapshots"))
    continued = ends.where("place < n_turns").select("place", "low", "high").distinct()
    return last.join(continued, ["place", "low", "high"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "snapshots")


def rendered(role: Column, text: Column) -> Column:
    """One turn in the chat template; a null role is ``unknown``, a null text empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, snapshots, chat) of every maximal conversation of rows (conv_id, turn, role, text).

    Turns are in the order of ``turn``, ties by role and text, nulls last; repeated rows are turns
    of their own. Rows without a conversation id are left out. Empty texts are turns. No rows give
    none; further columns are ignored. A conversation is one row of the result and must fit one.
    """
    prefixes = stage(turn_hashes(turns.where("conv_id is not null")), "turn-hashes")
    kept = stage(maximal_conversations(prefixes.select("conv_id", "place", "low", "high")), "maximal")
    spoken = prefixes.select("conv_id", "place", "role", "text").join(kept, "conv_id")
    ordered = F.array_sort(F.collect_list(F.struct("place", rendered(F.col("role"), F.col("text")).alias("line"))))
    chats = spoken.groupBy("conv_id", "n_turns", "snapshots").agg(ordered.alias("lines"))
    return chats.select("conv_id", "n_turns", "snapshots", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("chat"))
