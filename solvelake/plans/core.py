"""Adjudication and the success ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvelake.functions.common import epoch
from solvelake.operators import ledger
from solvelake.plans.registry import query
from solvelake.sources import testbed as tb

SOLVE = "id, user_id, team_id, challenge_id chall_id, correct, counted, cast(epoch(inserted_at) as bigint) time"
SOLVES = """
solves as (
  select a.*, s.attempt_id is not null counted
  from attempts a left join successes s on s.attempt_id = a.id)
"""


def solve_rows(df):
    return df.select(
        "id", "user_id", "team_id", F.col("challenge_id").alias("chall_id"), "correct", "counted",
        epoch("inserted_at").alias("time"),
    )


@query(
    "adjudicated_attempts",
    """
    select a.id, a.correct guess_correct,
           exists (select 1 from attempts b where b.correct and b.challenge_id = a.challenge_id
                   and b.team_id = a.team_id and (b.inserted_at < a.inserted_at
                     or (b.inserted_at = a.inserted_at and b.id < a.id))) already_solved,
           a.id in (select attempt_id from successes) counted
    from attempts a
    """,
)
def adjudicated_attempts(spark, sf):
    bare = tb.attempts(spark, sf).drop("correct")
    return ledger.adjudicate(bare, tb.challenges(spark, sf)).select(
        "id", F.col("correct").alias("guess_correct"), "already_solved", "counted"
    )


@query(
    "adjudicated_second_batch",
    """
    select a.id, a.correct guess_correct,
           exists (select 1 from attempts b where b.correct and b.challenge_id = a.challenge_id
                   and b.team_id = a.team_id and (b.inserted_at < a.inserted_at
                     or (b.inserted_at = a.inserted_at and b.id < a.id))) already_solved,
           a.id in (select attempt_id from successes) counted
    from attempts a where a.inserted_at >= timestamp '2024-01-15 00:00:00'
    """,
)
def adjudicated_second_batch(spark, sf):
    """Attempts of the second half against the ledger of the first."""
    a = tb.stored_attempts(spark, sf)
    late = F.col("inserted_at") >= F.lit(tb.START).cast("timestamp_ntz")
    old = ledger.first_correct(a.where(~late))
    return ledger.adjudicate(a.where(late).drop("correct"), tb.challenges(spark, sf), old).select(
        "id", F.col("correct").alias("guess_correct"), "already_solved", "counted"
    )


@query(
    "success_ledger",
    "select attempt_id, user_id, challenge_id, team_id, cast(epoch(solved_at) as bigint) solved_at from successes",
)
def success_ledger(spark, sf):
    return tb.successes(spark, sf).withColumn("solved_at", epoch("solved_at"))


@query("solves_with_counted", f"select {SOLVE} from solves", SOLVES)
def solves_with_counted(spark, sf):
    return solve_rows(ledger.solves(tb.attempts(spark, sf), tb.successes(spark, sf)))


@query("solves_by_team", f"select {SOLVE} from solves where team_id in (select id from teams where eligible)", SOLVES)
def solves_by_team(spark, sf):
    s = ledger.solves(tb.attempts(spark, sf), tb.successes(spark, sf))
    return solve_rows(ledger.solves_of(s, tb.teams(spark, sf).where("eligible").select("id"), "team_id"))


@query(
    "solves_by_chall",
    f"select {SOLVE} from solves where challenge_id in (select id from challenges where visible)",
    SOLVES,
)
def solves_by_chall(spark, sf):
    s = ledger.solves(tb.attempts(spark, sf), tb.successes(spark, sf))
    return solve_rows(ledger.solves_of(s, tb.challenges(spark, sf).where("visible").select("id"), "challenge_id"))


@query("solves_by_user", f"select {SOLVE} from solves where user_id in (select id from users where eligible)", SOLVES)
def solves_by_user(spark, sf):
    s = ledger.solves(tb.attempts(spark, sf), tb.successes(spark, sf))
    return solve_rows(ledger.solves_of(s, tb.users(spark, sf).where("eligible").select("id"), "user_id"))
