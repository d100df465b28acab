"""Joins of many rows with one row per key, where one key may hold a large part of the rows.

At run time Spark splits the oversized partition of a hot key, but only when both join inputs are
plain shuffles. An aggregate by the join key is partitioned by it already, so the join would take
it as it is, and the hot key would stay in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detach(per_key: DataFrame) -> DataFrame:
    """Scatter a per-key table, so that a join on its key shuffles both sides and can split a hot key."""
    columns = [f"`{c}`" for c, kind in per_key.dtypes if "map<" not in kind]
    return per_key.repartition(F.xxhash64(*columns))
