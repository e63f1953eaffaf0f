"""Boilerplate lines: lines that more than a given share of one host's pages contain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvelake.llm.base import let, store


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    """Equal for lines that differ only in outer spaces; null for lines without a word."""
    trimmed = F.trim(F.translate(line, "\t\r\x0b\x0c", "    "))
    return F.when(trimmed != "", F.xxhash64(trimmed))


def boilerplate_lines(
    docs: DataFrame, host: str = "source", max_ratio: float = 0.1, min_pages: int = 5
) -> DataFrame:
    """One row per host that has boilerplate: ``host`` and ``keys``, the hashes of its boilerplate lines.

    A line is boilerplate if more than ``max_ratio`` of the host's pages contain it, and ``min_pages`` or more. So a
    host has at most its mean number of lines per page, divided by ``max_ratio``, of them: that bounds the array.
    """
    keys = F.array_distinct(F.transform(_lines(F.col("text")), _key))
    page = docs.select(F.col(host).alias("host"), F.explode(F.array_compact(F.array_append(keys, F.lit(0)))).alias("key"))
    # Key 0 stands for the page itself, so that one aggregate counts pages and lines.
    pages_with = page.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    candidates, _ = store(pages_with.filter((F.col("key") == 0) | (F.col("n") >= min_pages)), "lines")
    per_host = candidates.filter("key = 0").select(F.col("host").alias("_host"), F.col("n").alias("pages"))
    common = candidates.filter("key <> 0").join(per_host, F.col("host").eqNullSafe(F.col("_host")))
    return (
        common.filter(F.col("n") > max_ratio * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("key").alias("keys"))
    )


def line_dedup(
    docs: DataFrame, host: str = "source", max_ratio: float = 0.1, min_pages: int = 5, counts: bool = True
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and, with ``counts``, ``n_lines`` and ``n_removed`` added.

    Lines end at a newline and compare without outer white space, by 64-bit hashes within a host; lines without a
    word stay. A null text stays null and has no lines, though its page counts. A null host is a host of its own.
    Repeated rows are pages of their own. Columns of ``docs`` with the names of the counts are replaced by them.
    """
    # Stored first: its size is then known, and a small one is sent to the tasks instead of shuffling the texts.
    found, _ = store(boilerplate_lines(docs, host, max_ratio, min_pages), "boilerplate")
    found = found.select(F.col("host").alias("_h"), "keys")
    rows = docs.select(F.struct("*").alias("_row"), F.col(host).alias("_host"), F.col("text").alias("_text"))
    joined = rows.join(found, F.col("_host").eqNullSafe(F.col("_h")), "left")

    def clean(lines: Column) -> Column:
        kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("keys"), _key(x)), F.lit(False)))
        return let(
            kept,
            lambda k: F.struct(
                F.array_join(k, "\n").alias("text"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(k)).cast("long").alias("n_removed"),
            ),
        )

    none = F.struct(
        F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n_lines"),
        F.lit(0).cast("long").alias("n_removed"),
    )
    out = joined.select("_row", F.when(F.col("_text").isNull(), none).otherwise(let(_lines(F.col("_text")), clean)).alias("_out"))
    added = ["n_lines", "n_removed"] if counts else []
    own = [c for c in docs.columns if c not in added]
    columns = [(F.col("_out.text") if c == "text" else F.col("_row").getField(c)).alias(c) for c in own]
    return out.select(*columns, *[F.col(f"_out.{c}") for c in added])
