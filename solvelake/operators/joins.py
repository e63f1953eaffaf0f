"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_join(log: DataFrame, one_per_key: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join (left, inner, semi or anti) a log, where one key may hold much of the rows, with one row per key.

    The aggregate arrives already partitioned by ``on``, and adaptive execution splits a hot partition only if both
    sides come straight from an exchange. A hash of the keys as an extra join key makes the planner exchange the
    (much smaller) aggregate once more, so that the hot key of the log can be split.
    """
    slot = F.xxhash64(*on).alias("_slot")
    left = log.select("*", slot)
    right = one_per_key.select("*", slot)
    return left.join(right, [*on, "_slot"], how).drop("_slot")
