"""The score and lookup operators under SQL names, for callers who write SQL.

Each function reads a temporary view of an operator's result, so a query over many ids is one equi-join with that
result. The score at an instant reads two: a probe meets one array of its team's gains by hour and one of the gains by
second in its own hour, of 3600 numbers at most, however many solves the team has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvelake.operators import leaderboard, scores


def register(
    spark: SparkSession,
    teams: DataFrame,
    users: DataFrame,
    challenges: DataFrame,
    links: DataFrame,
    ledger: DataFrame,
    prefix: str = "",
) -> None:
    """Create the temporary functions get_score_team, get_score_user, get_solves_chall, get_team_score_at,
    links_of_type and get_top_n_teams over the given tables. ``teams`` has its stored scores.

    get_team_score_at equals ``scores.score_at``: whole seconds, solves strictly before the instant, zero without any
    (an unknown team, a null instant).

    ``prefix`` goes before the names of the functions, and of the views that they read, so that sets of functions over
    different tables can stand side by side.
    """
    id_type = dict(teams.dtypes)["id"]
    seconds, hours = scores.gains(ledger, challenges)
    views = {
        "solvelake_seconds": seconds,
        "solvelake_hours": hours,
        "solvelake_team_scores": scores.team_scores(teams, ledger, challenges).select("team_id", "score"),
        "solvelake_user_scores": scores.user_scores(users, ledger, challenges).select("user_id", "score"),
        "solvelake_solve_counts": scores.solve_counts(challenges, ledger),
        "solvelake_links": links.select("challenge_id", "url", "type"),
        "solvelake_top": leaderboard.ranked(teams).select("rank", F.col("id").alias("team_id")),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)

    # A subquery that finds nothing is null: ids without a row count as zero, as in the operators.
    def scalar(name: str, args: str, select: str) -> None:
        spark.sql(f"create or replace temporary function {prefix}{name}({args}) returns bigint return coalesce(({select}), 0L)")

    def rows(name: str, args: str, returns: str, select: str) -> None:
        spark.sql(f"create or replace temporary function {prefix}{name}({args}) returns table({returns}) return {select}")

    one = f"which {id_type}"
    scalar("get_score_team", one, f"select max(score) from {prefix}solvelake_team_scores where team_id = which")
    scalar("get_score_user", one, f"select max(score) from {prefix}solvelake_user_scores where user_id = which")
    scalar("get_solves_chall", one, f"select max(solve_count) from {prefix}solvelake_solve_counts where challenge_id = which")
    # Subqueries with an inequality would become nested-loop joins: both have plain keys and give an array, whose sum is
    # taken by a function of its own, since a lambda may not hold a subquery.
    second = "unix_seconds(cast(at_time as timestamp))"
    spark.sql(
        f"""create or replace temporary function {prefix}gained_before(gains array<struct<at: bigint, gain: bigint>>, upto bigint)
        returns bigint return coalesce(aggregate(gains, 0L, (total, x) -> if(x.at < upto, total + x.gain, total)), 0L)"""
    )
    spark.sql(
        f"""create or replace temporary function {prefix}get_team_score_at(which {id_type}, at_time timestamp_ntz)
        returns bigint return
        {prefix}gained_before(
          (select any_value(gains) from {prefix}solvelake_hours where team_id = which), {second} div {scores.SLICE})
        + {prefix}gained_before(
          (select any_value(gains) from {prefix}solvelake_seconds
           where team_id = which and hour = {second} div {scores.SLICE}), {second})"""
    )
    rows(
        "links_of_type",
        f"{one}, kind string",
        "url string",
        f"select url from {prefix}solvelake_links where challenge_id = which and type = kind",
    )
    # The view ranks all teams; the limit of a request is judged by leaderboard.check_limit.
    rows("get_top_n_teams", "n int", f"id {id_type}", f"select team_id from {prefix}solvelake_top where rank <= n")
