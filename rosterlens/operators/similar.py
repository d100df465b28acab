"""Pairs of similar names, without comparing everybody with everybody.

Two names are similar when ``1 - distance / longer length`` is above the threshold, so the
distance is at most ``(1 - threshold) * longer length``: a few edits. If the right name is cut
into one piece more than that, some piece stands unchanged in the left name, near its old place.
Joining on (lengths, piece number, piece text) finds every similar pair; the score is checked afterwards.

Names with a common beginning share pieces with everyone. Pieces that would meet too many
partners are taken out, and the names that touch them are joined on what is left of a name
after so many edits. Where two edits are the most, that is a skeleton: the name with letters masked
that may be exchanged and without letters that may be missing. Names share a skeleton
only if they are within the edits, so hardly a candidate is turned down. What all such names of a
group begin and end with is cut off before, as it adds nothing to their distance. Where three edits are
allowed, deletion variants serve (the name without up to three letters).

Inside, groups and names are numbers: a pair is four of them, however long the names are.

Exploded sides are joined by sorting: their size is that of the small table before the explosion
in the planner's eyes, so it must not choose to broadcast them.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.text import NAME_THRESHOLD, edit_score
from rosterlens.session import spread, stage

# A piece that would meet more partners than this is replaced by deletion variants.
BUSY_PIECE_PAIRS = 2_000
# Skeletons serve pairs that may differ in so many letters.
SKELETON_MAX_EDITS = 2
# Deletion variants serve names that may differ in so many letters; longer names keep to pieces.
VARIANT_MAX_EDITS = 3
SLACK = 1e-9
# Stands for any letter of a skeleton.
MASK = "\u0000"


def _edits(length: Column, threshold: float) -> Column:
    """Most edits between similar names whose longer one has this length."""
    return F.floor(length * F.lit(1.0 - threshold) + SLACK).cast("int")


def _longest_partner(length: Column, threshold: float) -> Column:
    return F.floor(length / F.lit(threshold) + SLACK).cast("int")


def _piece(length: Column, pieces: Column, i: Column) -> tuple[Column, Column]:
    """1-based start and size of piece ``i`` (from 0) of a name cut into even pieces, long ones last."""
    size = F.floor(length / pieces).cast("int")
    short = pieces - length % pieces
    return i * size + F.greatest(F.lit(0), i - short) + 1, size + (i >= short).cast("int")


def _longest_with(edits: int, threshold: float) -> int:
    """The longest name that may differ in no more than so many letters."""
    return math.ceil((edits + 1) / (1.0 - threshold) - SLACK) - 1


def _lengths(lengths: list[int]) -> Column:
    return F.lit(lengths).cast("array<int>")


def _right_pieces(names: DataFrame, group: list[str], threshold: float, lengths: list[int] | None = None) -> DataFrame:
    """Pieces for every number of edits: that of shorter and equal partners, and those of longer ones, of ``lengths`` if given."""
    least, most = _edits(F.col("w_len"), threshold), _edits(_longest_partner(F.col("w_len"), threshold), threshold)
    some = F.sequence(F.greatest(least, F.lit(1)), most)
    if lengths is not None:
        met = F.transform(_lengths(lengths), lambda n: _edits(F.greatest(n, F.col("w_len")), threshold))
        some = F.array_intersect(some, met)
    cut = names.where(most >= 1).withColumn("_k", F.explode(some))
    cut = cut.where("w_len > _k").withColumn("piece_no", F.explode(F.expr("sequence(0, _k)")))
    start, size = _piece(F.col("w_len"), F.col("_k") + 1, F.col("piece_no"))
    return cut.select(*names.columns, F.col("_k").alias("edits"), "piece_no", F.substr("w", start, size).alias("piece"))


def _left_pieces(names: DataFrame, group: list[str], threshold: float, lengths: list[int] | None = None) -> DataFrame:
    """Where a piece of a right name of each possible length, of ``lengths`` if given, may stand in a left name; names are distinct."""
    shortest = F.ceil(F.col("v_len") * F.lit(threshold) - SLACK).cast("int")
    some = F.sequence(F.greatest(shortest, F.lit(1)), _longest_partner(F.col("v_len"), threshold))
    if lengths is not None:
        some = F.array_intersect(some, _lengths(lengths))
    cut = names.withColumn("w_len", F.explode(some))
    # Both lengths are known here, so the edits are those of the longer name of this very pair.
    cut = cut.withColumn("_k", _edits(F.greatest("v_len", "w_len"), threshold))
    cut = cut.where("_k >= 1 and w_len > _k and abs(v_len - w_len) <= _k").withColumn("piece_no", F.explode(F.expr("sequence(0, _k)")))
    start, size = _piece(F.col("w_len"), F.col("_k") + 1, F.col("piece_no"))
    cut = cut.withColumn("_start", start).withColumn("_size", size)
    # Edits left of the piece shift it by at most piece_no, edits right of it by at most _k - piece_no.
    shift = F.col("v_len") - F.col("w_len")
    low = F.greatest(F.lit(1), F.col("_start") - F.col("piece_no"), F.col("_start") + shift - (F.col("_k") - F.col("piece_no")))
    high = F.least(
        F.col("v_len") - F.col("_size") + 1,
        F.col("_start") + F.col("piece_no"),
        F.col("_start") + shift + (F.col("_k") - F.col("piece_no")),
    )
    cut = cut.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    pieces = F.array_distinct(F.transform(F.expr("sequence(_low, _high)"), lambda at: F.substr("v", at, F.col("_size"))))
    return cut.select(*names.columns, "w_len", F.col("_k").alias("edits"), "piece_no", F.explode(pieces).alias("piece"))


def _one_shorter(words: Column) -> Column:
    def drop_each(word: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.length(word)),
            lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)),
        )

    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 0), drop_each)))


def _variants(name: str, threshold: float) -> Column:
    """Hashes of the name and of what is left after dropping up to as many letters as it may differ in.

    Unequal variants with equal hashes only add a candidate, which the score then turns down.
    """
    edits = _edits(F.length(name), threshold)
    level = F.array(F.col(name))
    found = level
    for k in range(1, VARIANT_MAX_EDITS + 1):
        level = F.when(edits >= k, _one_shorter(level)).otherwise(F.array().cast("array<string>"))
        found = F.concat(found, level)
    return F.transform(F.array_distinct(found), lambda t: F.xxhash64(t))


def _masked(word: Column) -> Column:
    """The word with one letter masked, for each letter; an empty word stays."""
    one = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))),
        lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.lit(MASK), F.substr(word, i + 1)),
    )
    return F.when(F.length(word) > 0, one).otherwise(F.array(word))


def _masked_twice(word: Column) -> Column:
    def both(i: Column, j: Column) -> Column:
        return F.concat(F.substr(word, F.lit(1), i - 1), F.lit(MASK), F.substr(word, i + 1, j - i - 1), F.lit(MASK), F.substr(word, j + 1))

    last = F.greatest(F.length(word), F.lit(2))
    two = F.flatten(F.transform(F.sequence(F.lit(1), last - 1), lambda i: F.transform(F.sequence(i + 1, last), lambda j: both(i, j))))
    return F.when(F.length(word) > 1, two).otherwise(_masked(word))


def _skeletons(text: Column, length: Column, lengths: list[int], threshold: float, left: bool) -> Column:
    """Hashes of all that a partner within the edits may share of ``text``, a name of ``length`` without its group's common ends.

    ``lengths`` are those of partners. The longer name of a pair leaves out the letters that the other lacks; the edits that are
    left mask letters. Names of one length may also leave out a letter each. Both lengths are in the hash, the ``left`` name's first.
    Unequal skeletons with equal hashes only add a candidate.
    """
    none = F.array().cast("array<string>")

    def edits(n: Column, k: int) -> Column:
        return _edits(n, threshold) == k

    def shared(more: int, words: Column) -> Column:
        partner = (length + more).cast("int")
        pair = (length, partner) if left else (partner, length)
        hashes = F.transform(F.array_distinct(words), lambda t: F.xxhash64(t, *pair))
        return F.when(F.array_contains(_lengths(lengths), partner), hashes).otherwise(F.array().cast("array<bigint>"))

    shorter = _one_shorter(F.array(text))
    return F.concat(
        shared(0, F.when(edits(length, 1), _masked(text)).when(edits(length, 2), F.concat(_masked_twice(text), shorter)).otherwise(none)),
        shared(1, F.when(edits(length + 1, 1), F.array(text)).when(edits(length + 1, 2), _masked(text)).otherwise(none)),
        shared(2, F.when(edits(length + 2, 2), F.array(text)).otherwise(none)),
        shared(-1, F.when(edits(length, 1), shorter).when(edits(length, 2), F.flatten(F.transform(shorter, _masked))).otherwise(none)),
        shared(-2, F.when(edits(length, 2), _one_shorter(shorter)).otherwise(none)),
    )


def _common_ends(texts: DataFrame) -> DataFrame:
    """(_group, _head, _tail): how many letters all texts of a group begin and end with. The least and the greatest text show it."""

    def shared(a: Column, b: Column) -> Column:
        most = F.least(F.length(a), F.length(b))
        differs = F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
        at = F.array_position(differs, True).cast("int")
        return F.when(most < 1, F.lit(0)).when(at > 0, at - 1).otherwise(most)

    back = F.reverse("t")
    ends = texts.groupBy("_group").agg(
        F.min("t").alias("_a"), F.max("t").alias("_b"), F.min(back).alias("_c"), F.max(back).alias("_d"), F.min(F.length("t")).alias("_n")
    )
    ends = ends.withColumn("_head", shared(F.col("_a"), F.col("_b")))
    return ends.select("_group", "_head", F.least(shared(F.col("_c"), F.col("_d")), F.col("_n") - F.col("_head")).alias("_tail"))


class Matches(NamedTuple):
    """Numbered groups (group, _group), their distinct names (_group, v, v_len, v_id) and (_group, w, w_len, w_id), and pairs (_group, v_id, w_id, score)."""

    groups: DataFrame
    left: DataFrame
    right: DataFrame
    pairs: DataFrame


def match_names(
    left: DataFrame, right: DataFrame, group: list[str], threshold: float = NAME_THRESHOLD,
    busy_piece_pairs: int = BUSY_PIECE_PAIRS,
) -> Matches:
    """Pairs of distinct names of one group with a score above the threshold, as numbers."""
    if not 0.5 < threshold < 1.0:
        raise ValueError("the threshold must lie between 0.5 and 1")
    number = F.monotonically_increasing_id()
    groups = stage(left.select(*group).distinct().withColumn("_group", number), "name-groups")

    def numbered(side: DataFrame, c: str) -> DataFrame:
        names = side.join(groups, group).select("_group", c).distinct()
        names = spread(names, c).withColumn(f"{c}_len", F.length(c)).withColumn(f"{c}_id", number)
        return stage(names, "left-names" if c == "v" else "right-names")

    lv, rw = numbered(left, "v"), numbered(right, "w")
    # As few as names have lengths: pieces for lengths that no partner has are not cut.
    lengths = {c: sorted(r[0] for r in t.select(f"{c}_len").where(F.col(c).isNotNull()).distinct().collect()) for c, t in (("v", lv), ("w", rw))}
    equal = lv.join(rw.withColumnRenamed("w", "v"), ["_group", "v"]).select("_group", "v_id", "w_id", F.lit(1.0).alias("score"))

    at = ["_group", "w_len", "edits", "piece_no", "piece"]
    lp, rp = _left_pieces(lv, ["_group"], threshold, lengths["w"]), _right_pieces(rw, ["_group"], threshold, lengths["v"])
    meets = lp.groupBy(*at).agg(F.count("*").alias("_l")).hint("merge").join(rp.groupBy(*at).agg(F.count("*").alias("_r")), at)
    busy = meets.where(F.col("_l") * F.col("_r") > busy_piece_pairs).select(*at)
    busy = stage(busy, "busy-pieces")
    if busy.isEmpty():
        near = _scored(lp.hint("merge").join(rp, at), threshold)
    else:
        near = _scored(lp.join(busy, at, "left_anti").hint("merge").join(rp, at), threshold)
        lb, rb = lp.join(busy, at, "left_semi"), rp.join(busy, at, "left_semi")
        near = near.unionByName(_busy_pairs(lb, rb, at, threshold, lengths))
    return Matches(groups, lv, rw, equal.unionByName(near.distinct()))


def similar_names(
    left: DataFrame, right: DataFrame, group: list[str], threshold: float = NAME_THRESHOLD,
    busy_piece_pairs: int = BUSY_PIECE_PAIRS,
) -> DataFrame:
    """Pairs (group, v, w, score) of distinct names of one group with a score above the threshold."""
    groups, lv, rw, pairs = match_names(left, right, group, threshold, busy_piece_pairs)
    named = pairs.hint("merge").join(lv.drop("_group", "v_len"), "v_id").hint("merge").join(rw.drop("_group", "w_len"), "w_id")
    return named.join(groups, "_group").select(*group, "v", "w", "score")


def _scored(met: DataFrame, threshold: float) -> DataFrame:
    """Numbers and score of the pairs of unequal names whose score is above the threshold."""
    scored = met.where("v <> w").withColumn("score", edit_score(F.col("v"), F.col("w")))
    return scored.where(F.col("score") > threshold).select("_group", "v_id", "w_id", "score")


def _busy_pairs(lb: DataFrame, rb: DataFrame, at: list[str], threshold: float, lengths: dict[str, list[int]]) -> DataFrame:
    """Pairs among names that touch a busy piece: by skeleton if short, by variant if longer, by piece if long."""
    short, limit = (_longest_with(k, threshold) for k in (SKELETON_MAX_EDITS, VARIANT_MAX_EDITS))
    longest = F.greatest("v_len", "w_len")
    reach = {c: _longest_partner(F.col(c), threshold) > limit for c in ("v_len", "w_len")}
    long_pairs = _scored(lb.where(reach["v_len"]).hint("merge").join(rb.where(reach["w_len"]), at).where(longest > limit), threshold)

    def names(rows: DataFrame, c: str, wanted: Column) -> DataFrame:
        return spread(rows.where(wanted).select("_group", c, f"{c}_len", f"{c}_id").distinct(), f"{c}_id")

    def middle(c: str, other: str) -> Column:
        """May the longer name of a pair be one for variants?"""
        n = F.col(f"{c}_len")
        partners = [x for x in lengths[other] if short < x <= limit]
        return (n <= limit) & ((n > short) | F.exists(_lengths(partners), lambda x: x <= _longest_partner(n, threshold)))

    lvar, rvar = names(lb, "v", middle("v", "w")), names(rb, "w", middle("w", "v"))
    middle_pairs = _scored(
        lvar.withColumn("variant", F.explode(_variants("v", threshold))).hint("merge")
        .join(rvar.withColumn("variant", F.explode(_variants("w", threshold))), ["_group", "variant"]).where(longest > short),
        threshold,
    )

    ls, rs = names(lb, "v", F.col("v_len") <= short), names(rb, "w", F.col("w_len") <= short)
    ends = stage(_common_ends(ls.select("_group", F.col("v").alias("t")).unionByName(rs.select("_group", F.col("w").alias("t")))), "common-ends")

    def bones(side: DataFrame, c: str, other: str) -> DataFrame:
        text = F.substr(c, F.col("_head") + 1, F.col(f"{c}_len") - F.col("_head") - F.col("_tail"))
        cut = side.join(ends, "_group").select("_group", f"{c}_id", f"{c}_len", text.alias(c))
        partners = [x for x in lengths[other] if x <= short]
        return cut.withColumn("bone", F.explode(_skeletons(F.col(c), F.col(f"{c}_len"), partners, threshold, c == "v")))

    # The common ends count in the length of a name, but not in the distance.
    met = bones(ls, "v", "w").hint("merge").join(bones(rs, "w", "v"), ["_group", "bone"]).where("v <> w")
    short_pairs = met.withColumn("score", F.lit(1.0) - F.levenshtein("v", "w") / longest).where(F.col("score") > threshold)
    return long_pairs.unionByName(middle_pairs).unionByName(short_pairs.select("_group", "v_id", "w_id", "score"))
