"""Archive-and-delete, clearing of challenges, cascades."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvelake.functions.common import stamp
from solvelake.operators.refresh import recompute_challenges, recompute_owners
from solvelake.schemas import FOREIGN_KEYS
from solvelake.session import cut


class Solves(NamedTuple):
    attempts: DataFrame
    successes: DataFrame
    archive: DataFrame


def delete_solves(solves: Solves, ids: DataFrame, now: str | None) -> Solves:
    """Move the attempts ``ids`` (id) to the archive and drop their successes.

    A deleted success does not promote the team's next correct attempt, and no score changes.
    """
    gone = solves.attempts.join(ids.select("id"), "id", "left_semi").withColumn("deleted_at", stamp(now))
    keys = ids.select("id")
    return Solves(
        solves.attempts.join(keys, "id", "left_anti"),
        solves.successes.join(keys.withColumnRenamed("id", "attempt_id"), "attempt_id", "left_anti"),
        solves.archive.unionByName(gone),
    )


class Cleared(NamedTuple):
    solves: Solves
    users: DataFrame
    teams: DataFrame
    challenges: DataFrame
    archived: DataFrame


def clear_challenges(
    solves: Solves, users: DataFrame, teams: DataFrame, challenges: DataFrame, ids: DataFrame, now: str | None
) -> Cleared:
    """Delete all solves of the challenges ``ids`` (challenge_id), then recompute every score and solve count.

    ``archived`` lists every archived attempt of those challenges, also those of earlier calls. ``last_solve`` is left
    as it was; see ``refresh.repair_last_solve``.
    """
    doomed = solves.attempts.join(ids.select("challenge_id"), "challenge_id", "left_semi").select("id")
    left = delete_solves(solves, doomed, now)
    return Cleared(
        left,
        recompute_owners(users, left.successes, challenges, "user_id"),
        recompute_owners(teams, left.successes, challenges, "team_id"),
        recompute_challenges(challenges, left.successes),
        left.archive.join(ids.select("challenge_id"), "challenge_id", "left_semi").select("id"),
    )


def cascade_delete(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Delete the rows ``ids`` (id) of ``table`` and, along the foreign keys, all rows that hang on them.

    Rows with a null key stay. The archive has no foreign keys and stays.
    """
    gone = {table: cut(ids.select("id").distinct())}
    out = dict(tables)
    out[table] = tables[table].join(gone[table], "id", "left_anti")
    for child in ("users", "challenge_links", "solve_attempts", "solve_successes", "auth_name_pass", "auth_oauth"):
        keys = [(col, parent) for c, col, parent in FOREIGN_KEYS if c == child and parent in gone]
        if child not in tables or not keys:
            continue
        # One pass over the child: a row is marked by each dead parent it has.
        rows = out[child]
        for col, parent in keys:
            dead = gone[parent].select(F.col("id").alias(col), F.lit(True).alias(f"_{col}"))
            rows = rows.join(dead, col, "left")
        lost = F.coalesce(*[F.col(f"_{col}") for col, _ in keys], F.lit(False))
        out[child] = rows.where(~lost)
        # Rows deleted outright and rows lost through a parent both take their children along.
        if "id" in rows.columns and any(parent == child for _, _, parent in FOREIGN_KEYS):
            own = rows.where(lost).select("id")
            gone[child] = cut((own if child not in gone else gone[child].unionByName(own)).distinct())
    return {name: df.select(*tables[name].columns) for name, df in out.items()}
