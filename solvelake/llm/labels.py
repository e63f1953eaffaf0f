"""Bounded training samples for the classifiers, and the documents that they may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvelake.llm.base import held_out


def sample(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each label 0 and 1, and ``weight``, the number of rows that each stands for.

    Rows are chosen by a hash of ``doc_id``, so the same table gives the same sample in any order and on any cluster.
    Rows whose label is null or another are left out.
    """
    rows = rows.filter(F.col(label).isin(0, 1))
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    share: Column = F.lit(1.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == value, F.lit(min(1.0, per_class / n))).otherwise(share)
    at = (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return rows.filter(at < share).withColumn("weight", 1 / share)


def trainable(docs: DataFrame) -> DataFrame:
    """``docs`` without the quarter that is held out."""
    return docs.filter(~held_out(F.col("doc_id")))
