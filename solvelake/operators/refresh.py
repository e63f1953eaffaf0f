"""Stored scores and solve counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvelake.functions.common import stamp
from solvelake.operators.joins import split_join
from solvelake.operators.scores import totals, with_points


def _stored(table: DataFrame, column: str, new) -> DataFrame:
    """Replace ``column`` and keep its type."""
    return table.withColumn(column, new.cast(table.schema[column].dataType))


def refresh_owners(
    owners: DataFrame, ledger: DataFrame, challenges: DataFrame, fresh: DataFrame, key: str, now: str | None
) -> DataFrame:
    """Users or teams after the successes ``fresh`` came in: touched rows get their full score from ``ledger``.

    ``ledger`` holds ``fresh`` too. Scores are summed anew, not added to; ``last_solve`` and ``updated_at`` become
    ``now``; other rows stay as they are.
    """
    touched = fresh.select(key).distinct()
    sums = totals(with_points(split_join(ledger, touched, [key], "left_semi"), challenges), key).select(
        F.col(key).alias("id"), F.col("score").alias("_score")
    )
    hit = F.col("_score").isNotNull()
    out = owners.join(sums, "id", "left")
    out = _stored(out, "score", F.coalesce("_score", "score"))
    return out.withColumns(
        {c: F.when(hit, stamp(now)).otherwise(F.col(c)) for c in ("last_solve", "updated_at")}
    ).select(*owners.columns)


def refresh_challenges(challenges: DataFrame, ledger: DataFrame, fresh: DataFrame, now: str | None) -> DataFrame:
    """Challenges after the successes ``fresh``: touched rows get their full solve count."""
    touched = fresh.select("challenge_id").distinct()
    counts = (
        split_join(ledger, touched, ["challenge_id"], "left_semi")
        .groupBy(F.col("challenge_id").alias("id"))
        .agg(F.count("attempt_id").alias("_count"))
    )
    out = challenges.join(counts, "id", "left")
    out = _stored(out, "solve_count", F.coalesce("_count", "solve_count"))
    touch = F.when(F.col("_count").isNotNull(), stamp(now)).otherwise(F.col("updated_at"))
    return out.withColumn("updated_at", touch).select(*challenges.columns)


def recompute_owners(owners: DataFrame, ledger: DataFrame, challenges: DataFrame, key: str) -> DataFrame:
    """Rewrite ``score`` of every user or team; ``last_solve`` and ``updated_at`` stay."""
    sums = totals(with_points(ledger, challenges), key).select(F.col(key).alias("id"), F.col("score").alias("_score"))
    out = owners.join(sums, "id", "left")
    return _stored(out, "score", F.coalesce("_score", F.lit(0))).select(*owners.columns)


def recompute_challenges(challenges: DataFrame, ledger: DataFrame) -> DataFrame:
    counts = ledger.groupBy(F.col("challenge_id").alias("id")).agg(F.count("attempt_id").alias("_count"))
    out = challenges.join(counts, "id", "left")
    return _stored(out, "solve_count", F.coalesce("_count", F.lit(0))).select(*challenges.columns)


def repair_last_solve(owners: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Set ``last_solve`` to the time of the latest counted solve, null without one."""
    last = ledger.groupBy(F.col(key).alias("id")).agg(F.max("solved_at").alias("_last"))
    return owners.join(last, "id", "left").withColumn("last_solve", F.col("_last")).select(*owners.columns)
