"""Top teams and their score history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvelake.operators import scores
from solvelake.session import cut

MAX_TEAMS = 100


def check_limit(limit: int) -> int:
    if limit > MAX_TEAMS:
        raise ValueError(f"request too big: {limit} > {MAX_TEAMS}")
    if limit < 0:
        raise ValueError(f"negative limit: {limit}")
    return limit


def order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("last_solve"), F.asc("inserted_at"), F.asc("id")]


def top_teams(teams: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` teams by score, then earliest last solve (teams without one last), then age.

    The rank is taken over the at most 100 rows left after the limit.
    """
    check_limit(limit)
    top = teams.orderBy(*order()).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order())).cast("bigint"))


def ranked(teams: DataFrame) -> DataFrame:
    """Every team with its ``rank``.

    Teams are dealt out by ranges of the order, and each part counts from where the parts before it end; only the sizes
    of the parts come to the driver.
    """
    parts = int(teams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = teams.repartitionByRange(parts, *order()).sortWithinPartitions(*order())
    at = F.col("_at")
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()))
    # The id counts up from 2**33 times the number of the part.
    placed = placed.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(2**33 - 1)})
    sizes = sorted(tuple(r) for r in placed.groupBy("_part").agg(F.count(F.lit(1))).collect())  # one row per part
    starts, before = [], 0
    for part, n in sizes:
        starts.append((part, before))
        before += n
    starts = teams.sparkSession.createDataFrame(starts, "_part bigint, _before bigint")
    rank = F.col("_before") + F.col("_at") + 1
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", rank).select(*teams.columns, "rank")


def top_team_details(teams: DataFrame, limit: int) -> DataFrame:
    """Public columns of the top teams with their rank."""
    return top_teams(teams, limit).select("rank", "id", "name", "score", "last_solve", "eligible", "affiliation")


def top_teams_history(
    teams: DataFrame, ledger: DataFrame, challenges: DataFrame, limit: int, start: str
) -> DataFrame:
    """Initial score at ``start`` and one entry per later counted solve for each top team."""
    # At most MAX_TEAMS ids, so the broadcast is bounded. Both are stored, since each is used several times.
    ids = F.broadcast(cut(top_teams(teams, limit).select(F.col("id").alias("team_id"))))
    own = cut(ledger.join(ids, "team_id", "left_semi"))
    return scores.initial_scores(ids, own, challenges, start).unionByName(
        scores.score_history(own, challenges, start)
    )
