"""Session options and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# forceOptimizeSkewedJoin: a hot challenge, team or user may hold a large share of the attempt log. Joins against
# the log are split even where the split costs one more exchange for a later aggregate.
OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_local_root: str | None = None


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options the operators rely on."""
    for key, value in OPTIONS.items():
        spark.conf.set(key, value)
    return spark


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="solvelake-")
    return _local_root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the work folder."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once: write it under the work folder and read it back.

    The plan that goes on starts from files, so a lost executor costs no recomputation, and the sizes the planner sees
    are real ones.
    """
    spark = df.sparkSession
    path = work_path(spark, "cut")
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


_written: dict[str, set[str]] = {}


def release(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for these frames; no frame that still reads them may be used any more."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path is not None:
            _delete(df.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete all that ``cut`` wrote in this application, once its results have been used."""
    for path in list(_written.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)
