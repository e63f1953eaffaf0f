"""Deployment identifiers and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvelake.functions.common import stable_id, uuid_of


def deploy_ids(requests: DataFrame, challenges: DataFrame, new_id: Column | None = None) -> DataFrame:
    """Requests (request_id, chall, force_wipe) with ``deploy_id``.

    ``chall`` is a uuid in any spelling or a source folder; whatever reads as a uuid is one. Wiped and unknown challenges get a new id
    (``new_id`` may use the request columns).
    """
    made = stable_id("deploy", "request_id", "chall") if new_id is None else new_id
    known = challenges.select(F.col("source_folder").alias("chall"), F.col("id").cast("string").alias("_id"))
    chosen = (
        F.when(F.col("force_wipe"), made)
        .otherwise(F.coalesce(uuid_of("chall"), "_id", made))
    )
    return requests.join(known, "chall", "left").withColumn("deploy_id", chosen).drop("_id")


def latest_statuses(log: DataFrame) -> DataFrame:
    """(chall, status, status_time, ts): the last report per challenge, ties to the highest ``seq``."""
    last = F.max_by(F.struct("status", "status_time", "ts"), F.struct("ts", "seq"))
    return log.groupBy("chall").agg(last.alias("s")).select("chall", "s.*")
