"""Streaming readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from solvelake.session import ROCKSDB
from solvelake.sources import envelope


def read_files(
    spark: SparkSession, path: str, ddl: str, fmt: str = "parquet", glob: str | None = None, per_trigger: int | None = None,
    archive: str | None = None,
) -> DataFrame:
    """Files of a folder as a stream with a declared schema; ``per_trigger`` bounds the files of one micro-batch.

    Files that a finished batch has read move to the folder ``archive``, if one is given, so that the listing of the
    source does not grow.
    """
    reader = spark.readStream.schema(ddl).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path)


def read_requests(spark: SparkSession, path: str, fmt: str = "json", id_type: str = "string", **kw) -> DataFrame:
    """The files of ``envelope.read_requests`` as a stream; ``kw`` as for ``read_files``."""
    return read_files(spark, path, envelope.requests_ddl(id_type), fmt, **kw)


def once(requests: DataFrame, received: str | None = None, within: str = "1 hour") -> DataFrame:
    """Requests without those whose ``request_id`` came before: a client that asks again gets no second answer.

    The ids seen are state: for ever, or, with a column ``received`` of instants, until the watermark ``within`` behind
    the latest of them has passed; requests older than that are dropped. A null id is one id.
    """
    if received is None:
        return requests.dropDuplicates(["request_id"])
    timed = requests.withColumn("_received", F.col(received).cast("timestamp")).withWatermark("_received", within)
    return timed.dropDuplicatesWithinWatermark(["request_id"]).drop("_received")


def start_routing(
    requests: DataFrame, path: str, checkpoint: str, id_type: str = "string", trigger: dict | None = None,
    received: str | None = None, within: str = "1 hour",
) -> StreamingQuery:
    """Write routed commands (JSON parameters) partitioned by target, refused requests under the target "refused".

    A request that arrives twice is routed once (see ``once``).
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    judged = envelope.judge(once(requests, received, within), id_type)
    none = F.struct(
        F.lit("refused").alias("target"), F.col("reason").alias("kind"), F.lit(None).cast("variant").alias("params")
    )
    rows = F.when(F.col("reason").isNull(), F.col("members")).otherwise(F.array(none))
    routed = judged.select("request_id", F.inline(rows)).withColumn("params", F.to_json("params"))
    return (
        routed.writeStream.outputMode("append")
        .format("parquet")
        .partitionBy("target")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
