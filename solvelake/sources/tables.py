"""Readers and writers for the competition tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvelake import schemas


def read_table(
    spark: SparkSession,
    table: str,
    path: str | None = None,
    fmt: str = "parquet",
    id_type: str = "string",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read one competition table with its declared schema.

    ``fmt='jdbc'`` takes the connection from ``options`` (url, dbtable, and the partitioning options); the database
    then names the types and the declared columns are selected from it.
    """
    reader = spark.read.format(fmt).options(**dict(options or {}))
    if fmt == "jdbc":
        df = reader.load()
        return df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.schema(table, id_type)])
    return reader.schema(schemas.schema(table, id_type)).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", by: str | None = None):
    """Write one snapshot; ``by`` partitions a log by a column that readers prune on."""
    writer = df.write.format(fmt).mode(mode)
    if by:
        writer = writer.partitionBy(by)
    writer.save(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
