"""Scores now, at an instant, and over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvelake.functions.common import epoch, stamp
from solvelake.sources import buckets

SLICE = 3600  # seconds per slice of a running total


def with_points(ledger: DataFrame, challenges: DataFrame) -> DataFrame:
    """Ledger rows with the points of their challenge."""
    return ledger.join(challenges.select(F.col("id").alias("challenge_id"), "points"), "challenge_id")


def totals(scored: DataFrame, key: str) -> DataFrame:
    """Sum of points and time of the latest counted solve per ``key``."""
    return scored.groupBy(key).agg(
        F.sum("points").cast("bigint").alias("score"), F.max("solved_at").alias("last_solve")
    )


def _scores(owners: DataFrame, ledger: DataFrame, challenges: DataFrame, key: str) -> DataFrame:
    t = totals(with_points(ledger, challenges), key)
    return (
        owners.select(F.col("id").alias(key))
        .join(t, key, "left")
        .withColumn("score", F.coalesce("score", F.lit(0).cast("bigint")))
    )


def team_scores(teams: DataFrame, ledger: DataFrame, challenges: DataFrame) -> DataFrame:
    """(team_id, score, last_solve) for every team, zero without solves."""
    return _scores(teams, ledger, challenges, "team_id")


def user_scores(users: DataFrame, ledger: DataFrame, challenges: DataFrame) -> DataFrame:
    """(user_id, score, last_solve) for every user; follows the user, not the team at solve time."""
    return _scores(users, ledger, challenges, "user_id")


def solve_counts(challenges: DataFrame, ledger: DataFrame) -> DataFrame:
    """(challenge_id, solve_count) for every challenge."""
    counts = ledger.groupBy("challenge_id").agg(F.count("attempt_id").alias("solve_count"))
    return (
        challenges.select(F.col("id").alias("challenge_id"))
        .join(counts, "challenge_id", "left")
        .withColumn("solve_count", F.coalesce("solve_count", F.lit(0).cast("bigint")))
    )


def with_scores(owners: DataFrame, ledger: DataFrame, challenges: DataFrame, key: str) -> DataFrame:
    """``owners`` with ``score`` and ``last_solve`` taken from the ledger."""
    t = totals(with_points(ledger, challenges), key).withColumnRenamed(key, "id")
    bare = owners.drop("score", "last_solve")
    return bare.join(t, "id", "left").withColumn("score", F.coalesce("score", F.lit(0).cast("bigint")))


def points_before(scored: DataFrame, instants: DataFrame | None = None) -> DataFrame:
    """Points each team had strictly before each instant.

    ``scored`` has (team_id, second, points); ``instants`` has more (team_id, second). Returns (team_id, second,
    before) for every distinct pair of either. Points are first summed per team and second, then a running total is kept
    inside each hour and one over the hours: a window holds at most 3600 rows, or one row per hour of the event,
    however many solves one team has.
    """
    marks = scored.select("team_id", "second", F.col("points").cast("bigint").alias("points"))
    if instants is not None:
        nothing = F.lit(0).cast("bigint").alias("points")
        marks = marks.unionByName(instants.select("team_id", "second", nothing))
    # Stated here, the filters that the joins below would infer are the same for both uses of the sums, so that the
    # planner shuffles them once.
    keyed = marks.withColumn("hour", F.expr(f"second div {SLICE}")).where(
        "team_id is not null and second is not null and hour is not null"
    )
    per_second = keyed.groupBy("team_id", "hour", "second").agg(F.sum("points").alias("gain"))

    earlier = (Window.unboundedPreceding, -1)
    by_hour = Window.partitionBy("team_id").orderBy("hour").rowsBetween(*earlier)
    in_hour = Window.partitionBy("team_id", "hour").orderBy("second").rowsBetween(*earlier)
    hours = (
        per_second.groupBy("team_id", "hour")
        .agg(F.sum("gain").alias("gain"))
        .select("team_id", "hour", F.sum("gain").over(by_hour).alias("hours_before"))
    )
    zero = F.lit(0).cast("bigint")
    return (
        per_second.withColumn("inside", F.sum("gain").over(in_hour))
        .join(hours, ["team_id", "hour"])
        .select(
            "team_id",
            "second",
            (F.coalesce("hours_before", zero) + F.coalesce("inside", zero)).alias("before"),
        )
    )


def _seconds(ledger: DataFrame, challenges: DataFrame) -> DataFrame:
    return with_points(ledger, challenges).withColumn("second", epoch("solved_at"))


def gains(ledger: DataFrame, challenges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points won by each team as ``gains``, an array of (at, gain): per (team_id, hour) by second, at most ``SLICE``
    of them, and per team_id by hour, one for each hour of the event with solves."""
    scored = _seconds(ledger, challenges).where("team_id is not null and second is not null")
    marks = scored.withColumn("hour", F.expr(f"second div {SLICE}"))
    per_second = marks.groupBy("team_id", "hour", "second").agg(F.sum("points").cast("bigint").alias("gain"))
    per_hour = marks.groupBy("team_id", "hour").agg(F.sum("points").cast("bigint").alias("gain"))

    def listed(at: str) -> Column:
        return F.collect_list(F.struct(F.col(at).alias("at"), "gain")).alias("gains")

    return per_second.groupBy("team_id", "hour").agg(listed("second")), per_hour.groupBy("team_id").agg(listed("hour"))


def score_at(probes: DataFrame, ledger: DataFrame, challenges: DataFrame) -> DataFrame:
    """``probes`` (team_id, at, ...) with ``score``: points of solves strictly before ``at``."""
    p = probes.withColumn("second", epoch("at"))
    before = points_before(_seconds(ledger, challenges), p.select("team_id", "second"))
    return (
        p.join(before, ["team_id", "second"], "left")
        .withColumn("score", F.coalesce("before", F.lit(0).cast("bigint")))
        .drop("second", "before")
    )


def score_at_stored(
    probes: DataFrame, path: str, challenges: DataFrame, upto: int | None = None, parts: int = buckets.BUCKETS
) -> DataFrame:
    """``score_at`` against a ledger in buckets of teams (see ``attempts.store_ledger``), as of now or of version ``upto``.

    Only the buckets of the probed teams are opened.
    """
    types = dict(probes.dtypes)["team_id"], dict(challenges.dtypes)["id"]
    ddl = f"team_id {types[0]}, challenge_id {types[1]}, solved_at timestamp_ntz"
    own = buckets.touched(probes, ["team_id"], parts)
    return score_at(probes, buckets.read(probes.sparkSession, f"{path}/team_id", ddl, own, upto), challenges)


def initial_scores(team_ids: DataFrame, ledger: DataFrame, challenges: DataFrame, start: str) -> DataFrame:
    """(team_id, score, time): the score of every listed team at ``start``, solves at ``start`` not yet in."""
    before = totals(with_points(ledger.where(F.col("solved_at") < stamp(start)), challenges), "team_id")
    return team_ids.select("team_id").join(before, "team_id", "left").select(
        "team_id",
        F.coalesce("score", F.lit(0).cast("bigint")).alias("score"),
        stamp(start).alias("time"),
    )


def score_history(ledger: DataFrame, challenges: DataFrame, start: str) -> DataFrame:
    """(team_id, score, time) per counted solve since ``start``.

    The score is that of all solves before the second of this one plus its own points: two solves of a team in one
    second each show the earlier total plus their own. Solves before ``start`` feed the totals and are then dropped.
    """
    scored = _seconds(ledger, challenges)
    shown = scored.where(F.col("solved_at") >= stamp(start))
    before = points_before(scored)
    return shown.join(before, ["team_id", "second"]).select(
        "team_id", (F.col("before") + F.col("points")).alias("score"), F.col("solved_at").alias("time")
    )
