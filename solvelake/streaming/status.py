"""Latest deployment status per challenge, live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from solvelake.streaming import changes

KEYS = ["chall"]


def running_status(log: DataFrame) -> DataFrame:
    """Log rows (seq, chall, status, status_time, ts) to the last report per challenge."""
    return changes.running(log, KEYS, F.struct("ts", "seq", "status", "status_time"), "max")


def start_status(log: DataFrame, path: str, checkpoint: str, **kw) -> StreamingQuery:
    return changes.start(running_status(log), path, checkpoint, "max", **kw)


def read_status(spark: SparkSession, path: str, log: DataFrame) -> DataFrame:
    folded = changes.fold(changes.read_log(spark, path, running_status(log).schema), KEYS, "max")
    return folded.select("chall", "best.status", "best.status_time", "best.ts")
