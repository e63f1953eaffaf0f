"""Commands that depend on one another, applied in order: connected groups, and one streaming pass over each.

Whether a command succeeds may hang on all commands before it, so no number of joins known beforehand settles a batch.
But commands that share no key do not touch one another: groups of connected keys are found in a logarithmic number of
rounds, and each is then read once, in order, by one task that holds what its commands have changed so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from solvelake.operators.joins import split_join
from solvelake.session import cut, release

#: Commands of one group up to which one task reads them; larger groups go on in rounds.
GROUP = 1_000_000


def in_turn(commands: DataFrame, seq: str = "seq") -> DataFrame:
    """``commands``, stored, with ``_at``: their place in a total order.

    That is ``seq``, then a hash of the command; equal commands stand in some order. ``_at`` is null where ``seq`` is.
    """
    place = F.struct(F.col(seq).alias("seq"), F.xxhash64(F.to_json(F.struct("*"))).alias("tie"), F.monotonically_increasing_id().alias("row"))
    return cut(commands.withColumn("_at", F.when(F.col(seq).isNotNull(), place)))


def node(kind: str, key: Column | str) -> Column:
    """A number for a key. Two keys of one number would only make one group of two."""
    return F.xxhash64(F.lit(kind), F.col(key) if isinstance(key, str) else key)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def groups(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``group``: the smallest number that links (``a``, ``b``) of numbers reach from each number.

    Large stars and small stars in turn: a chain of a thousand links ends in about ten rounds. Every round is stored;
    minima are combined before the shuffle, and joins with a hub are split.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    alone = cut(edges.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("group")))
    edges = cut(edges.where("u > v"))
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = cut(split_join(both.where("v > u"), low, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = split_join(large, low, ["u"], "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = cut(rest.union(low.select("u", "m")).distinct())
        release(edges, large)
        edges, before, mark = small, mark, _mark(small)
        if mark == before:
            break
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("group"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct()
    return found.union(roots).union(alone.join(found.select("node"), "node", "left_anti")).distinct()


def pass_over(
    rows: DataFrame, group: str, order: list[str], fresh: Callable[[], object], step: Callable[[object, tuple], bool],
    reads: list[str], keep: list[str],
) -> DataFrame:
    """``keep`` of the rows for which ``step`` says so, each group's rows being shown to it in ``order``.

    ``step`` gets what ``fresh()`` made for the group, which it may change, and the columns ``reads`` of the row. Rows
    stream through; a task holds one group's state at a time.
    """
    sent = rows.select(F.col(group).alias("_group"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                       *[F.col(c).alias(f"_r{i}") for i, c in enumerate(reads)], *keep)
    out = StructType([sent.schema[c] for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, fresh()
        for batch in batches:
            columns = [batch.column(f"_r{i}").to_pylist() for i in range(len(reads))]
            taken = []
            for i, row in enumerate(zip(batch.column("_group").to_pylist(), *columns, strict=True)):
                if row[0] != now:
                    now, state = row[0], fresh()
                if step(state, row[1:]):
                    taken.append(i)
            yield batch.select(keep).take(pa.array(taken, pa.int64()))

    dealt = sent.repartition("_group").sortWithinPartitions("_group", *[f"_o{i}" for i in range(len(order))])
    return dealt.mapInArrow(run, out)
