"""Partial updates: a batch of patches equals applying them one at a time in ``seq`` order.

A null field of a patch leaves the column as it is, so the value that stands is the last non-null one. A tri-state
field ``x`` comes with a boolean ``has_x``: set, cleared (``has_x`` and null) or left alone. A patch without a ``seq``
has no place in the order: it changes nothing and affects no row. Patches of one ``seq`` apply by the value they set,
the largest last.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvelake.functions.common import fold, stamp
from solvelake.operators.quality import change_duplicates, unless_clashes
from solvelake.schemas import UNIQUE


def fold_patches(patches: DataFrame, key: str, fields: Sequence[str], tri_state: Sequence[str] = ()) -> DataFrame:
    """One row per key with the last value per field; tri-state fields become a struct that is null if untouched."""

    def latest(value: Column, given: Column) -> Column:
        return F.max(F.when(given, F.struct(F.col("seq").alias("seq"), value.alias("v"))))

    last = [latest(F.col(f), F.col(f).isNotNull())["v"].alias(f"_{f}") for f in fields]
    last += [latest(F.struct(F.col(f).alias("v")), F.col(f"has_{f}"))["v"].alias(f"_{f}") for f in tri_state]
    placed = patches.where("seq is not null")
    return placed.groupBy(F.col(key).alias("id")).agg(*last, F.count(F.lit(1)).alias("_patches"))


def apply_patches(
    table: DataFrame,
    patches: DataFrame,
    key: str,
    fields: Sequence[str],
    tri_state: Sequence[str] = (),
    touch: bool = False,
    now: str | None = None,
    unique: str | None = None,
) -> DataFrame:
    """``table`` after all patches; with ``touch``, ``updated_at`` of patched rows becomes ``now`` (None: the clock).

    ``unique`` names the table whose unique keys the patches must leave whole; only the keys that they change are
    looked at (see ``quality.unless_clashes``).
    """
    folded = fold_patches(patches, key, fields, tri_state)
    new = {f: F.coalesce(f"_{f}", f) for f in fields}
    keys = [k for k in UNIQUE.get(unique, []) if set(k) <= set(fields)] if unique else []
    for f in tri_state:
        new[f] = F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v")).otherwise(F.col(f))
    if touch:
        new["updated_at"] = F.when(F.col("_patches").isNotNull(), stamp(now)).otherwise(F.col("updated_at"))
    extra = [f"_{f}" for f in [*fields, *tri_state]]
    out = table.join(folded, "id", "left").withColumns(new).drop("_patches", *extra)
    if not keys:
        return out
    columns = [c for c in fields if any(c in k for k in keys)]
    changed = folded.where(reduce(lambda a, b: a | b, [F.col(f"_{c}").isNotNull() for c in columns]))
    after = table.select("id", *{c for k in keys for c in k}).join(changed.withColumn("_wrote", F.lit(True)), "id", "left")
    after = after.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).withColumn("_wrote", F.coalesce("_wrote", F.lit(False)))
    written = changed.select(*[F.col(f"_{c}").alias(c) for c in columns])
    return unless_clashes(out, change_duplicates(after, written, unique), unique)


def patch_outcomes(patches: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(seq, id, affected): 1 if the patched row exists, else 0 (the request fails); 0 without a ``seq``."""
    known = table.select(F.col("id").alias(key), F.lit(1).cast("bigint").alias("_n"))
    zero = F.lit(0).cast("bigint")
    return patches.select("seq", key).join(known, key, "left").select(
        "seq", F.col(key).alias("id"), F.when(F.col("seq").isNull(), zero).otherwise(F.coalesce("_n", zero)).alias("affected")
    )


def patch_teams(teams: DataFrame, patches: DataFrame, unique: bool = True) -> DataFrame:
    """Patches (seq, team_id, name, description, eligible, affiliation, has_affiliation); no ``updated_at`` change.

    Here and below, a batch after which a row shares a unique key that it wrote is refused as a whole: the result
    fails when it is used. ``unique=False`` leaves that check to the caller.
    """
    fields = ["name", "description", "eligible"]
    return apply_patches(teams, patches, "team_id", fields, ["affiliation"], unique="teams" if unique else None)


def patch_users(users: DataFrame, patches: DataFrame, now: str | None, unique: bool = True) -> DataFrame:
    """Patches (seq, user_id, name, eligible, admin)."""
    fields = ["name", "eligible", "admin"]
    return apply_patches(users, patches, "user_id", fields, touch=True, now=now, unique="users" if unique else None)


CHALLENGE_FIELDS = [
    "name", "description", "points", "authors", "hints", "categories", "tags", "visible", "source_folder",
]


def patch_challenges(challenges: DataFrame, patches: DataFrame, now: str | None, unique: bool = True) -> DataFrame:
    """Patches (seq, challenge_id, the nine fields, links); see ``patched_links`` for the links."""
    table = "challenges" if unique else None
    return apply_patches(challenges, patches, "challenge_id", CHALLENGE_FIELDS, touch=True, now=now, unique=table)


def patched_links(patches: DataFrame) -> DataFrame:
    """(challenge_id, links): the last link list given for each challenge, if any was."""
    given = patches.where("links is not null and seq is not null")
    last = F.max(F.struct("seq", "links"))["links"]
    return given.groupBy("challenge_id").agg(last.alias("links"))


def join_team(users: DataFrame, teams: DataFrame, commands: DataFrame, now: str | None) -> tuple[DataFrame, DataFrame]:
    """Commands (seq, user_id, team_name, auth_ok): users move to the team of that name in any case, last one wins.

    Returns the users and the commands with ``outcome``: name_does_not_exist, auth, does_not_exist (user) or joined.
    """
    named = teams.select(fold("name").alias("_key"), F.col("id").alias("_team"))
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_user"))
    outcome = (
        F.when(F.col("_team").isNull(), "name_does_not_exist")
        .when(~F.coalesce("auth_ok", F.lit(False)), "auth")
        .when(F.col("_user").isNull(), "does_not_exist")
        .otherwise("joined")
    )
    judged = (
        commands.withColumn("_key", fold("team_name"))
        .join(named, "_key", "left")
        .join(known, "user_id", "left")
        .withColumn("outcome", outcome)
        .withColumn("team_id", F.when(outcome == "joined", F.col("_team")))
        .drop("_key", "_team", "_user")
    )
    moves = judged.where("outcome = 'joined'").select("seq", "user_id", "team_id")
    return apply_patches(users, moves, "user_id", ["team_id"], touch=True, now=now), judged


def promote(users: DataFrame, judged: DataFrame, now: str | None) -> DataFrame:
    """Set ``admin`` for the targets of the commands that ``access.promotions`` let pass."""
    granted = judged.where("outcome = 'promoted'").select("seq", F.col("target_id").alias("user_id"))
    return apply_patches(users, granted.withColumn("admin", F.lit(True)), "user_id", ["admin"], touch=True, now=now)
