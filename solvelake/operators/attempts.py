"""A batch of solve claims from admission to the refreshed tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvelake.functions.common import stable_id
from solvelake.operators import access, ledger, refresh
from solvelake.operators.joins import split_join
from solvelake.session import cut
from solvelake.sources import buckets


#: Keys by which a stored ledger is dealt to buckets.
STORED = ["team_id", "user_id", "challenge_id"]
SOLVE = ["attempt_id", "user_id", "challenge_id", "team_id", "solved_at"]


class AttemptBatch(NamedTuple):
    judged: DataFrame  # every claim with its outcome
    attempts: DataFrame  # new rows of the log, with correct, already_solved and counted
    successes: DataFrame  # new rows of the ledger
    users: DataFrame
    teams: DataFrame
    challenges: DataFrame
    bloods: DataFrame  # first solves of a challenge within this batch, with names


def process(
    claims: DataFrame,
    credentials: DataFrame,
    users: DataFrame,
    teams: DataFrame,
    challenges: DataFrame,
    log: DataFrame,
    successes: DataFrame,
    now: str | None,
    success_id: Column | None = None,
    by: Mapping[str, DataFrame] | None = None,
) -> AttemptBatch:
    """Admit, log, count and score a batch of claims.

    ``claims`` is (id, user_id, team_id, challenge_id, flag_guess, inserted_at, sub, provider). ``log`` and
    ``successes`` are the attempt log and the ledger so far. The tables come back as they stand after the batch; the
    log and the ledger grow by ``attempts`` and ``successes``, which have the columns of those tables. ``success_id`` may
    use attempt_id. ``by`` may give parts of the ledger that hold all rows of the batch's teams (``team_id``), users
    (``user_id``) and challenges (``challenge_id``), to be read in place of the whole (see ``process_stored``).
    """
    of = {key: (by or {}).get(key, successes) for key in STORED}
    checked = access.oauth_matches(claims, credentials).withColumnRenamed("matches", "auth_ok")
    judged = access.admit(checked, users, challenges)
    admitted = judged.where("outcome = 'accepted'").select(
        "id", "user_id", "team_id", "challenge_id", "flag_guess", "inserted_at"
    )
    counted = ledger.adjudicate(admitted, challenges, of["team_id"]).withColumn("updated_at", F.col("inserted_at"))
    attempts = cut(counted)
    rows = attempts.where("counted").select(
        F.col("id").alias("attempt_id"), "user_id", "challenge_id", "team_id", F.col("inserted_at").alias("solved_at")
    )
    whole = {key: part.select(*rows.columns).unionByName(rows) for key, part in of.items()}
    fresh = rows.withColumn("id", stable_id("success", "attempt_id") if success_id is None else success_id)

    columns = ["id", "user_id", "team_id", "challenge_id", "correct", "inserted_at"]
    right = attempts.where("correct").select(*columns)
    # The ledger knows most challenges that were solved before; the log is asked about the rest only, since a deleted
    # success leaves none.
    unknown = split_join(right, of["challenge_id"].select("challenge_id").distinct(), ["challenge_id"], "left_anti")
    left = cut(unknown.select("challenge_id").distinct())
    solved_before = split_join(log.where("correct").select("challenge_id"), left, ["challenge_id"], "left_semi").distinct()
    candidates = split_join(unknown, solved_before, ["challenge_id"], "left_anti")
    return AttemptBatch(
        judged,
        attempts,
        fresh,
        refresh.refresh_owners(users, whole["user_id"], challenges, fresh, "user_id", now),
        refresh.refresh_owners(teams, whole["team_id"], challenges, fresh, "team_id", now),
        refresh.refresh_challenges(challenges, whole["challenge_id"], fresh, now),
        ledger.first_blood_details(candidates, challenges, teams, users),
    )


def store_ledger(log: DataFrame, successes: DataFrame, path: str, parts: int = buckets.BUCKETS) -> None:
    """Lay the ledger out in buckets of teams, of users and of challenges, and beside it the challenges with a correct
    attempt in the log, as version 0."""
    every = list(range(parts))
    for key in STORED:
        buckets.rewrite(successes.select(*SOLVE), f"{path}/{key}", [key], every, 0, parts)
    solved = log.where("correct").select("challenge_id").distinct()
    buckets.rewrite(solved, f"{path}/solved", ["challenge_id"], every, 0, parts)


def process_stored(
    claims: DataFrame,
    credentials: DataFrame,
    users: DataFrame,
    teams: DataFrame,
    challenges: DataFrame,
    path: str,
    version: int,
    now: str | None,
    success_id: Column | None = None,
    parts: int = buckets.BUCKETS,
) -> AttemptBatch:
    """``process`` against a ledger laid out by ``store_ledger``, which becomes ``version`` (one more than the last).

    Only the buckets that the teams, users and challenges of the claims fall into are read, and of them those with new
    successes are written anew. A batch repeated with its version starts from the versions before it.
    """
    claims = cut(claims)
    types = {"attempt_id": dict(claims.dtypes)["id"], **{k: dict(claims.dtypes)[k] for k in STORED}, "solved_at": "timestamp_ntz"}
    ddl = ", ".join(f"{c} {types[c]}" for c in SOLVE)
    spark = claims.sparkSession

    def part(key: str, rows: DataFrame) -> DataFrame:
        return buckets.read(spark, f"{path}/{key}", ddl, buckets.touched(rows, [key], parts), version - 1)

    by = {key: part(key, claims) for key in STORED}
    own = buckets.touched(claims, ["challenge_id"], parts)
    known = buckets.read(spark, f"{path}/solved", f"challenge_id {types['challenge_id']}", own, version - 1)
    log = known.withColumn("correct", F.lit(True))
    out = process(claims, credentials, users, teams, challenges, log, by["team_id"], now, success_id, by)
    fresh = cut(out.successes.select(*SOLVE))
    for key in STORED:
        changed = buckets.touched(fresh, [key], parts)
        if changed:
            buckets.rewrite(part(key, fresh).unionByName(fresh), f"{path}/{key}", [key], changed, version, parts)
    right = out.attempts.where("correct").select("challenge_id")
    changed = buckets.touched(right, ["challenge_id"], parts)
    if changed:
        before = buckets.read(spark, f"{path}/solved", known.schema, changed, version - 1)
        buckets.rewrite(before.unionByName(right).distinct(), f"{path}/solved", ["challenge_id"], changed, version, parts)
    return out
