"""Scores now, at an instant, and over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvelake.functions import sql
from solvelake.functions.common import epoch
from solvelake.operators import attempts, scores
from solvelake.operators.ledger import first_correct
from solvelake.plans.registry import query
from solvelake.session import cut, work_path
from solvelake.sources import testbed as tb

PRIOR = """
  cast(coalesce((select sum(c2.points) from successes p join challenges c2 on c2.id = p.challenge_id
                 where p.team_id = {team} and {at} < {limit}), 0) as bigint)
"""


def _ledger(spark, sf):
    return tb.successes(spark, sf), tb.challenges(spark, sf)


def _stored(spark, sf):
    return tb.stored_ledger(spark, sf), tb.challenges(spark, sf)


@query("team_scores", "select id team_id, score from scored_teams")
def team_scores(spark, sf):
    return scores.team_scores(tb.teams(spark, sf), *_ledger(spark, sf)).select("team_id", "score")


@query(
    "user_scores",
    """
    select u.id user_id, cast(coalesce((select sum(c.points) from successes s
      join challenges c on c.id = s.challenge_id where s.user_id = u.id), 0) as bigint) score
    from users u
    """,
)
def user_scores(spark, sf):
    return scores.user_scores(tb.users(spark, sf), *_ledger(spark, sf)).select("user_id", "score")


@query(
    "chall_solve_counts",
    """
    select c.id challenge_id,
           (select count(s.attempt_id) from successes s where s.challenge_id = c.id) solve_count
    from challenges c
    """,
)
def chall_solve_counts(spark, sf):
    return scores.solve_counts(tb.challenges(spark, sf), tb.successes(spark, sf))


@query(
    "last_solves",
    """
    select 'team' kind, team_id id, cast(epoch(max(solved_at)) as bigint) last_solve from successes group by team_id
    union all
    select 'user', user_id, cast(epoch(max(solved_at)) as bigint) from successes group by user_id
    """,
)
def last_solves(spark, sf):
    """Times of the latest counted solve per team and per user, from one pass over the ledger."""
    owners = F.explode(
        F.array(
            F.struct(F.lit("team").alias("kind"), F.col("team_id").alias("id")),
            F.struct(F.lit("user").alias("kind"), F.col("user_id").alias("id")),
        )
    )
    return (
        tb.successes(spark, sf)
        .select(owners.alias("o"), "solved_at")
        .groupBy("o.kind", "o.id")
        .agg(epoch(F.max("solved_at")).alias("last_solve"))
    )


ASOF = f"""
    select a.id, a.team_id, {PRIOR.format(team='a.team_id', at='p.solved_at', limit='a.inserted_at')} score
    from attempts a
    """


@query("team_score_asof", ASOF)
def team_score_asof(spark, sf):
    """The score of the team at the instant of each of its attempts."""
    log = tb.stored_attempts(spark, sf)
    probes = log.select("id", "team_id", F.col("inserted_at").alias("at"))
    return scores.score_at(probes, first_correct(log), tb.challenges(spark, sf)).select("id", "team_id", "score")


@query("team_score_asof_stored", ASOF)
def team_score_asof_stored(spark, sf):
    """The same from a ledger in buckets."""
    log = tb.stored_attempts(spark, sf)
    path = work_path(spark, "ledger-store")
    attempts.store_ledger(log, first_correct(log), path, 8)
    probes = log.select("id", "team_id", F.col("inserted_at").alias("at"))
    return scores.score_at_stored(probes, path, tb.challenges(spark, sf), parts=8).select("id", "team_id", "score")


@query("team_score_asof_sql", ASOF)
def team_score_asof_sql(spark, sf):
    """The same through the SQL name."""
    log = tb.stored_attempts(spark, sf)
    own, c = cut(first_correct(log)), tb.challenges(spark, sf)
    teams = scores.with_scores(tb.teams(spark, sf), own, c, "team_id")
    sql.register(spark, teams, tb.users(spark, sf), c, tb.links(spark, sf), own, prefix="asof_")
    log.createOrReplaceTempView("asof_attempts")
    return spark.sql("select id, team_id, asof_get_team_score_at(team_id, inserted_at) score from asof_attempts")


@query(
    "score_history",
    f"""
    select s.team_id, {PRIOR.format(team='s.team_id', at='p.solved_at', limit='s.solved_at')} + c.points score,
           s.solved_at "time"
    from successes s join challenges c on c.id = s.challenge_id
    where s.solved_at >= timestamp '2024-01-15 00:00:00'
    """,
)
def score_history(spark, sf):
    return scores.score_history(*_stored(spark, sf), tb.START)


@query(
    "score_history_daily",
    f"""
    select s.team_id,
           {PRIOR.format(team='s.team_id', at="date_trunc('day', p.solved_at)", limit="date_trunc('day', s.solved_at)")}
             + c.points score,
           cast(epoch(date_trunc('day', s.solved_at)) as bigint) day_start
    from successes s join challenges c on c.id = s.challenge_id
    where date_trunc('day', s.solved_at) >= timestamp '2024-01-15 00:00:00'
    """,
)
def score_history_daily(spark, sf):
    """History with instants cut to the day, so that many solves of a team share one instant."""
    day = F.date_trunc("day", "solved_at").cast("timestamp_ntz")
    led = tb.stored_ledger(spark, sf).withColumn("solved_at", day)
    return scores.score_history(led, tb.challenges(spark, sf), tb.START).select(
        "team_id", "score", epoch("time").alias("day_start")
    )


@query(
    "initial_scores",
    f"""
    select t.id team_id,
           {PRIOR.format(team='t.id', at='p.solved_at', limit="timestamp '2024-01-15 00:00:00'")} score,
           timestamp '2024-01-15 00:00:00' "time"
    from teams t
    """,
)
def initial_scores(spark, sf):
    ids = tb.teams(spark, sf).select(F.col("id").alias("team_id"))
    return scores.initial_scores(ids, *_ledger(spark, sf), tb.START)
