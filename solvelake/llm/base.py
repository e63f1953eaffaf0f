"""Helpers that the operators of this package share: session options, stored steps, row keys, text pieces."""

from __future__ import annotations

import io
import pathlib
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvelake.session import tune, work_root

# Rows of text go to Python in small Arrow batches, so that a task holds few texts at a time.
BATCH_ROWS = "512"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: White space of the word rules: space and \\t to \\r.
SPACES = "[\\x20\\x09-\\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application, by a file in the shared work folder."""
    app = spark.sparkContext.applicationId
    top = pathlib.Path(__file__).parents[1]
    if app in _shipped or not top.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work_root(spark)}/package-{uuid.uuid4().hex}/solvelake.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path.toString())
    _shipped.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options that the operators rely on."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return tune(spark)


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` under the shared work folder; the table read back, and its path for ``discard``."""
    path = f"{work_root(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored steps that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of stored steps: it does so once the driver has collected their plans."""
    spark._jvm.System.gc()


def told(keys: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """``keys`` (a few numbers a row), stored, for a join with texts.

    They go to every task if there are at most ``limit``, so that the texts need no shuffle; more are left to a join
    by shuffle, with the same result.
    """
    table, _ = store(keys, "keys")
    return F.broadcast(table) if table.count() <= limit else table


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Runs of characters other than white space; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def windows(words: Column, size: int, of: Callable[[Column], Column] = F.xxhash64) -> Column:
    """``of`` every ``size`` consecutive words, in order; empty when there are fewer."""
    n = F.size(words)
    starts = F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: of(F.slice(words, i, size)))


def covered(starts: Column, sizes: int) -> Column:
    """Positions that ascending ``starts`` of runs of ``sizes`` cover together."""
    gaps = F.transform(
        starts, lambda p, j: F.least(F.lit(sizes), F.coalesce(F.get(starts, j + 1) - p, F.lit(sizes)))
    )
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def row_key(text: Column) -> Column:
    """With ``doc_id``, names a document: equal rows share it, rows of one id with other texts do not."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by the checksum of the id, that no model learns from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def parts_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
