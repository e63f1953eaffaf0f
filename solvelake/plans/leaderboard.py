"""Leaderboard, its history, and first bloods."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvelake.functions import sql
from solvelake.functions.common import epoch, stamp
from solvelake.functions.text import first_blood_message
from solvelake.operators import leaderboard, ledger, scores
from solvelake.plans.registry import query
from solvelake.plans.scores import PRIOR
from solvelake.sources import testbed as tb

TOP = """
top as (
  select *, row_number() over (order by score desc, last_solve asc nulls last, inserted_at, id) rank
  from scored_teams
  qualify rank <= {n})
"""

BLOODS = """
bloods as (
  select a.id attempt_id, a.inserted_at, a.challenge_id, c.name chall, u.name "user", t.name team
  from attempts a
  left join challenges c on c.id = a.challenge_id
  left join teams t on t.id = a.team_id
  left join users u on u.id = a.user_id
  where a.correct and (select b.id from attempts b where b.challenge_id = c.id and b.correct
                       order by b.inserted_at, b.id limit 1) = a.id)
"""


def scored_teams(spark, sf, led=None):
    led = tb.successes(spark, sf) if led is None else led
    return scores.with_scores(tb.teams(spark, sf), led, tb.challenges(spark, sf), "team_id")


@query("top_teams", "select cast(rank as bigint) rank, id from top", TOP.format(n=100))
def top_teams(spark, sf):
    return leaderboard.top_teams(scored_teams(spark, sf), 100).select("rank", "id")


@query(
    "top_teams_detail",
    """
    select cast(rank as bigint) rank, id, name, score, cast(epoch(last_solve) as bigint) last_solve, eligible,
           affiliation
    from top
    """,
    TOP.format(n=10),
)
def top_teams_detail(spark, sf):
    top = leaderboard.top_team_details(scored_teams(spark, sf), 10)
    return top.withColumn("last_solve", epoch("last_solve"))


@query(
    "top_teams_history",
    f"""
    select t.id team_id,
           {PRIOR.format(team='t.id', at='p.solved_at', limit="timestamp '2024-01-15 00:00:00'")} score,
           timestamp '2024-01-15 00:00:00' "time"
    from top t
    union all
    select s.team_id, {PRIOR.format(team='s.team_id', at='p.solved_at', limit='s.solved_at')} + c.points,
           s.solved_at
    from successes s join challenges c on c.id = s.challenge_id
    where s.team_id in (select id from top) and s.solved_at >= timestamp '2024-01-15 00:00:00'
    """,
    TOP.format(n=10),
)
def top_teams_history(spark, sf):
    led = tb.stored_ledger(spark, sf)
    return leaderboard.top_teams_history(scored_teams(spark, sf, led), led, tb.challenges(spark, sf), 10, tb.START)


@query("first_bloods", 'select attempt_id, chall, "user", team from bloods', BLOODS)
def first_bloods(spark, sf):
    return ledger.first_blood_details(
        tb.attempts(spark, sf), tb.challenges(spark, sf), tb.teams(spark, sf), tb.users(spark, sf)
    ).select("attempt_id", "chall", "user", "team")


@query(
    "first_blood_messages",
    """
    select attempt_id, 'First :drop_of_blood: by `' || replace("user", '`', '''') || '` from `'
           || replace(team, '`', '''') || '` on challenge `' || chall || '`!' message
    from bloods
    """,
    BLOODS,
)
def first_blood_messages(spark, sf):
    return first_bloods(spark, sf).select("attempt_id", first_blood_message("chall", "team", "user").alias("message"))


@query(
    "attempts_with_first_blood",
    "select a.id, a.id in (select attempt_id from bloods) is_first_blood from attempts a",
    BLOODS,
)
def attempts_with_first_blood(spark, sf):
    return ledger.is_first_blood(tb.attempts(spark, sf)).select("id", "is_first_blood")


@query(
    "sql_functions",
    """
    select t.id, t.score, t.id in (select id from top) listed,
           (select count(s.attempt_id) from successes s where s.challenge_id = t.id) solves
    from scored_teams t
    """,
    TOP.format(n=10),
)
def sql_functions(spark, sf):
    """Team scores and the top ten through the SQL names, and the solves of the challenge with the team's number."""
    led = tb.stored_ledger(spark, sf)
    sql.register(
        spark, scored_teams(spark, sf, led), tb.users(spark, sf), tb.challenges(spark, sf), tb.links(spark, sf), led
    )
    tb.teams(spark, sf).select("id").createOrReplaceTempView("solvelake_ids")
    return spark.sql(
        """
        select i.id, get_score_team(i.id) score, get_solves_chall(i.id) solves, t.id is not null listed
        from solvelake_ids i left join get_top_n_teams(10) t on t.id = i.id
        """
    )


@query(
    "sql_functions_of_users",
    """
    select u.id, u.score, u.score own, u.rank <= 150 listed,
           (select count(*) from links l where l.challenge_id = u.id and l.type = 'web') webs
    from ranked u
    """,
    """
    scored as (
      select u.id, cast(coalesce((select sum(c.points) from successes s join challenges c on c.id = s.challenge_id
                                  where s.user_id = u.id), 0) as bigint) score,
             (select max(s.solved_at) from successes s where s.user_id = u.id) last_solve
      from users u),
    ranked as (
      select *, row_number() over (order by score desc, last_solve asc nulls last, id) rank from scored)
    """,
)
def sql_functions_of_users(spark, sf):
    """All five SQL names where every user is a team, with more teams than a request may ask for."""
    led = tb.stored_ledger(spark, sf)
    c = tb.challenges(spark, sf)
    alone = tb.users(spark, sf).withColumns({"team_id": F.col("id"), "inserted_at": stamp(tb.START)})
    scored = scores.with_scores(alone, led.withColumn("team_id", F.col("user_id")), c, "team_id")
    own = led.withColumn("team_id", F.col("user_id"))
    sql.register(spark, scored, alone, c, tb.links(spark, sf), own, prefix="alone_")
    alone.select("id").createOrReplaceTempView("alone_ids")
    return spark.sql(
        """
        select i.id, alone_get_score_team(i.id) score, alone_get_score_user(i.id) own, t.id is not null listed,
               coalesce(w.webs, 0L) webs
        from alone_ids i left join alone_get_top_n_teams(150) t on t.id = i.id
        left join (select c.id, count(*) webs from alone_ids c, lateral alone_links_of_type(c.id, 'web') l group by c.id) w
          on w.id = i.id
        """
    )
