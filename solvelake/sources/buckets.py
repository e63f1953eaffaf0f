"""Tables in hash buckets, of which a batch reads and rewrites only those that its keys fall into.

A store is a folder with ``version=V/bucket=K``; a bucket stands in the newest version that has it. A version is marked
when it is complete, so one without the mark was never there; a repeated version overwrites its own files only. Two
versions stay readable, older files go.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
MARK = "_COMPLETE"


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def touched(keys_of: DataFrame, keys: list[str], buckets: int = BUCKETS) -> list[int]:
    """The buckets that rows fall into: at most ``buckets`` numbers come to the driver."""
    return sorted(r[0] for r in keys_of.select(bucket_of(keys, buckets)).distinct().collect())


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _listed(spark: SparkSession, path: str, name: str, mark: str | None = None) -> list[int]:
    """Numbers of the folders ``name``=number under ``path``, those with an entry ``mark`` if that is given."""
    fs, target = _files(spark, path)
    if not fs.exists(target):
        return []
    found = [s.getPath() for s in fs.listStatus(target) if s.getPath().getName().startswith(f"{name}=")]
    if mark:
        found = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, mark))]
    return sorted(int(p.getName().split("=")[1]) for p in found)


def _drop(spark: SparkSession, path: str) -> None:
    fs, target = _files(spark, path)
    fs.delete(target, True)


def manifest(spark: SparkSession, path: str, upto: int | None = None) -> dict[int, int]:
    """The version that each bucket stands in, now or after version ``upto``, from the names of the folders."""
    stands: dict[int, int] = {}
    for v in _listed(spark, path, "version", MARK):
        if upto is None or v <= upto:
            stands |= dict.fromkeys(_listed(spark, f"{path}/version={v}", "bucket"), v)
    return stands


def read(
    spark: SparkSession, path: str, schema: StructType | str, buckets: Iterable[int] | None = None, upto: int | None = None
) -> DataFrame:
    """Rows of the given buckets (all by default), as of now or of version ``upto``: one scan of their folders."""
    stands = manifest(spark, path, upto)
    chosen = stands if buckets is None else [k for k in buckets if k in stands]
    paths = [f"{path}/version={stands[k]}/bucket={k}" for k in chosen]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def rewrite(rows: DataFrame, path: str, keys: list[str], written: list[int], version: int, buckets: int = BUCKETS) -> None:
    """Make ``rows`` the whole content of the buckets ``written``, as ``version``; the others stay as they are."""
    spark = rows.sparkSession
    before = manifest(spark, path, version - 1)
    target = f"{path}/version={version}"
    # A rebalance deals a large bucket to several files.
    dealt = rows.withColumn("bucket", bucket_of(keys, buckets)).hint("rebalance", "bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(target)
    fs, _ = _files(spark, target)
    for name in [*[f"bucket={k}" for k in written], MARK]:  # buckets that are empty now have a folder too
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(target, name))
    _clean(spark, path, version, before | dict.fromkeys(written, version), before)


def _clean(spark: SparkSession, path: str, version: int, now: dict[int, int], before: dict[int, int]) -> None:
    """Delete the files that neither this version nor the one before reads."""
    needed = {(v, k) for stands in (before, now) for k, v in stands.items()}
    for v in _listed(spark, path, "version"):
        if v >= version:
            continue
        held = _listed(spark, f"{path}/version={v}", "bucket")
        gone = [k for k in held if (v, k) not in needed]
        for name in [f"version={v}"] if len(gone) == len(held) else [f"version={v}/bucket={k}" for k in gone]:
            _drop(spark, f"{path}/{name}")
