"""Connected components of a link table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvelake.llm.base import discard, store
from solvelake.operators.joins import split_join


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component``, its smallest reachable id, for every id in a link; the smallest itself is left out.

    Each round writes its edges and reads them back, so it depends on no executor. Only a count and a checksum come
    to the driver. Minima are combined before the shuffle, so a hub with very many links is one row per task.
    """
    spark = links.sparkSession
    edges, path = store(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        moved = split_join(both.filter("v > u"), lowest, ["u"], "inner")
        large = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = store(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small, small_path = store(rest.union(low).distinct(), "edges")
        discard(spark, path, large_path)
        edges, path, before, mark = small, small_path, mark, _mark(small)
        if mark == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
