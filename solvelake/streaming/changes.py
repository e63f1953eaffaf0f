"""Running extremes over a stream, kept as a log of changes.

The stateful part is a streaming minimum or maximum of a struct: it combines on the map side, so a hot key reaches the
state store as one row per task, and keeps one row per key. Every micro-batch appends the keys whose extreme changed to
a folder named by its batch id; a repeated batch overwrites its folder. Readers fold the log once more, which is exact
because extremes of extremes are extremes. Every so many batches the log so far is folded into a snapshot, and readers
take the newest snapshot and the batches after it. Folders behind the snapshot before that one are deleted, so neither
the folders nor the work of a batch grow with the number of batches.

State is kept for ever unless it is bounded: then it is kept per key and span of event time, and leaves with the
watermark. Later rows than that are dropped; extremes over all spans are extremes of the log, which stays whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from solvelake.operators.joins import split_join
from solvelake.session import ROCKSDB
from solvelake.sources.buckets import _drop, _listed

EXTREMES = {"min": F.min, "max": F.max}


@dataclass(frozen=True)
class Bound:
    """State is kept for spans of ``span`` of the column ``time``, until ``late`` after their end."""

    time: str
    span: str = "1 day"
    late: str = "1 hour"


def running(stream: DataFrame, keys: list[str], ordered: Column, pick: str, bound: Bound | None = None) -> DataFrame:
    """(keys, best): the smallest or largest struct ``ordered`` per key, and per ``span`` if state is bounded."""
    if bound is None:
        return stream.groupBy(*keys).agg(EXTREMES[pick](ordered).alias("best"))
    at = F.col(bound.time).cast("timestamp").alias("_time")
    spans = stream.select("*", at).withWatermark("_time", bound.late)
    return spans.groupBy(*keys, F.window("_time", bound.span).alias("span")).agg(EXTREMES[pick](ordered).alias("best"))


def log_schema(result: DataFrame) -> StructType:
    """The columns of the log of ``running``."""
    return result.drop("span").schema


def batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def snapshot_path(path: str, batch_id: int) -> str:
    return f"{path}-snapshots/upto={batch_id}"


def start(
    result: DataFrame,
    path: str,
    checkpoint: str,
    pick: str,
    then: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
    compact_every: int = 32,
) -> StreamingQuery:
    """Write the rows of each micro-batch whose extreme changed under ``path`` and run ``then`` on them as written."""
    spark = result.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = log_schema(result)
    keys = [c for c in schema.names if c != "best"]

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        target = batch_path(path, batch_id)
        rows = fold(batch, keys, pick) if "span" in batch.columns else batch
        if batch_id > 0:
            old = read_log(session, path, schema, batch_id - 1)
            mine = split_join(old, rows.select(*keys), keys, "left_semi")
            known = fold(mine, keys, pick).withColumnRenamed("best", "_best")
            better = "best < _best" if pick == "min" else "best > _best"
            rows = rows.join(known, keys, "left").where(f"_best is null or {better}").select(*schema.names)
        rows.write.mode("overwrite").parquet(target)
        if then is not None:
            then(session.read.schema(schema).parquet(target), batch_id)
        if compact_every and batch_id % compact_every == compact_every - 1:
            whole = fold(read_log(session, path, schema, batch_id, before=batch_id), keys, pick)
            whole.write.mode("overwrite").parquet(snapshot_path(path, batch_id))
            _retire(session, path)

    return (
        result.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _retire(spark: SparkSession, path: str) -> None:
    """Delete what only readers older than the last snapshot but one would need.

    The newest snapshot may be of a batch that is repeated after a failure; that batch starts from the one before.
    """
    done = sorted(_snapshots(spark, path))
    if len(done) < 2:
        return
    for b in done[:-2]:
        _drop(spark, snapshot_path(path, b))
    for b in _listed(spark, path, "batch_id"):
        if b <= done[-2]:
            _drop(spark, batch_path(path, b))


def read_log(
    spark: SparkSession, path: str, schema: StructType, upto: int | None = None, before: int | None = None
) -> DataFrame:
    """The newest snapshot (older than ``before``) and the changes after it, or what stood after the batch ``upto``, as
    far back as the last snapshot but one."""
    log = spark.read.schema(StructType([*schema.fields, StructField("batch_id", LongType())])).parquet(path)
    if upto is not None:
        log = log.where(F.col("batch_id") <= upto)
    done = [b for b in _snapshots(spark, path) if (upto is None or b <= upto) and (before is None or b < before)]
    if done:
        folded = spark.read.schema(schema).parquet(snapshot_path(path, max(done)))
        return folded.unionByName(log.where(F.col("batch_id") > max(done)).drop("batch_id"))
    return log.drop("batch_id")


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """Batches after which a finished snapshot was written."""
    return _listed(spark, f"{path}-snapshots", "upto", "_SUCCESS")


def fold(log: DataFrame, keys: list[str], pick: str) -> DataFrame:
    """The current extreme per key."""
    return log.groupBy(*keys).agg(EXTREMES[pick]("best").alias("best"))
