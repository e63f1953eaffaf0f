"""The attempt log and the success ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvelake.operators.joins import split_join

PAIR = ["challenge_id", "team_id"]


def check_guesses(attempts: DataFrame, challenges: DataFrame) -> DataFrame:
    """Add ``correct``: exact, case-sensitive equality with the flag; null for an unknown challenge."""
    flags = challenges.select(F.col("id").alias("challenge_id"), F.col("flag").alias("_flag"))
    return (
        attempts.join(flags, "challenge_id", "left")
        .withColumn("correct", F.col("flag_guess") == F.col("_flag"))
        .drop("_flag")
    )


def first_correct(attempts: DataFrame) -> DataFrame:
    """The ledger: the earliest correct attempt of each (challenge, team), ties to the smallest id.

    A minimum, not a window: it combines on the map side, so one team hammering one challenge costs one row per task.
    """
    first = F.min(F.struct("inserted_at", "id", "user_id"))
    return (
        attempts.where("correct")
        .groupBy(*PAIR)
        .agg(first.alias("first"))
        .select(
            F.col("first.id").alias("attempt_id"),
            F.col("first.user_id").alias("user_id"),
            *PAIR,
            F.col("first.inserted_at").alias("solved_at"),
        )
    )


def new_successes(checked: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows a batch of checked attempts adds; pairs already in ``ledger`` stay as they are."""
    fresh = first_correct(checked)
    return fresh if ledger is None else fresh.join(ledger.select(*PAIR), PAIR, "left_anti")


def adjudicate(attempts: DataFrame, challenges: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Each attempt with ``correct``, ``already_solved`` and ``counted``.

    ``already_solved`` means that its team had the challenge before this attempt. Attempts on unknown challenges get a
    null ``correct``; admission rejects those.
    """
    checked = check_guesses(attempts, challenges)
    marks = new_successes(checked, ledger).select(
        *PAIR, F.col("solved_at").alias("_at"), F.col("attempt_id").alias("_by"), F.lit(False).alias("_old")
    )
    if ledger is not None:
        old = ledger.select(
            *PAIR, F.col("solved_at").alias("_at"), F.col("attempt_id").alias("_by"), F.lit(True).alias("_old")
        )
        marks = marks.unionByName(old)
    earlier = F.struct(F.col("_at"), F.col("_by")) < F.struct(F.col("inserted_at"), F.col("id"))
    return (
        split_join(checked, marks, PAIR)
        .withColumn("already_solved", F.when(F.col("_old").isNull(), False).otherwise(F.col("_old") | earlier))
        .withColumn("counted", F.coalesce(~F.col("_old") & (F.col("_by") == F.col("id")), F.lit(False)))
        .drop("_at", "_by", "_old")
    )


def solves(attempts: DataFrame, successes: DataFrame) -> DataFrame:
    """The attempt log with ``counted``: the attempt has a row in the ledger."""
    s = successes.select(F.col("attempt_id").alias("id"), F.lit(True).alias("_hit"))
    return (
        attempts.join(s, "id", "left")
        .withColumn("counted", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def solves_of(solved: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Solves whose ``column`` is in the one-column frame ``ids``; repeated ids do not repeat rows."""
    keys = ids.select(F.col(ids.columns[0]).alias(column))
    return solved.join(keys, column, "left_semi")


def first_bloods(attempts: DataFrame) -> DataFrame:
    """The earliest correct attempt of each challenge, ties to the smallest id."""
    return (
        attempts.where("correct")
        .groupBy("challenge_id")
        .agg(F.min(F.struct("inserted_at", "id", "user_id", "team_id")).alias("f"))
        .select(
            "challenge_id",
            F.col("f.id").alias("attempt_id"),
            F.col("f.user_id").alias("user_id"),
            F.col("f.team_id").alias("team_id"),
            F.col("f.inserted_at").alias("solved_at"),
        )
    )


def named(df: DataFrame, table: DataFrame, key: str, as_: str) -> DataFrame:
    """Left join the ``name`` of the row that ``key`` points to."""
    return df.join(table.select(F.col("id").alias(key), F.col("name").alias(as_)), key, "left")


def first_blood_details(
    attempts: DataFrame, challenges: DataFrame, teams: DataFrame, users: DataFrame
) -> DataFrame:
    """First bloods with challenge, team and user names; attempts on unknown challenges have none."""
    known = challenges.select(F.col("id").alias("challenge_id"), F.col("name").alias("chall"))
    out = first_bloods(attempts).join(known, "challenge_id")
    return named(named(out, teams, "team_id", "team"), users, "user_id", "user")


def is_first_blood(attempts: DataFrame) -> DataFrame:
    """Flag each attempt that is the first correct one of its challenge."""
    hits = first_bloods(attempts).select(F.col("attempt_id").alias("id"), F.lit(True).alias("_hit"))
    return (
        attempts.join(hits, "id", "left")
        .withColumn("is_first_blood", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )
