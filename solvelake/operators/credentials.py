"""Replacement of sign-in credentials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvelake.functions.common import stable_id, stamp
from solvelake.operators import passes
from solvelake.operators.joins import split_join
from solvelake.session import cut, release

KEY = ["user_id", "provider_name"]
CHANGE = ["old_provider", "old_sub", "new_provider", "new_sub"]


def _chained(credentials: DataFrame, commands: DataFrame) -> DataFrame:
    """(_at) of the accepted commands where all commands of a user keep their provider.

    After an accepted command, the next one accepted is the first later one whose old subject is its new subject. So
    the accepted commands are those that links from command to command reach from the stored subject, and following
    links that double in length finds them in as many rounds as the longest chain has binary digits.
    """
    place = ["user_id", F.col("old_provider").alias("provider")]
    asks = commands.select(*place, F.col("old_sub").alias("sub"), "_at", F.col("_at").alias("asks"))
    none = F.lit(None).cast(commands.schema["_at"].dataType)
    gives = commands.select(*place, F.col("new_sub").alias("sub"), "_at", none.alias("asks"))
    # A command's new subject comes before its old one here, so that no command follows itself.
    later = Window.partitionBy("user_id", "provider", "sub").orderBy(F.desc("_at"), F.desc("gives"))
    after = F.min("asks").over(later.rowsBetween(Window.unboundedPreceding, -1))
    both = asks.withColumn("gives", F.lit(False)).unionByName(gives.withColumn("gives", F.lit(True)))
    links = cut(both.withColumn("next", after).where("gives and next is not null").select("_at", "next"))
    stored = credentials.select("user_id", F.col("provider_name").alias("provider"), "sub")
    reached = cut(
        asks.join(stored, ["user_id", "provider", "sub"], "left_semi")
        .groupBy("user_id", "provider")
        .agg(F.min("_at").alias("_at"))
        .select("_at")
    )
    while not links.isEmpty():
        step = reached.join(links, "_at").select(F.col("next").alias("_at"))
        wider = cut(reached.unionByName(step).distinct())
        second = links.select(F.col("_at").alias("next"), F.col("next").alias("_far"))
        farther = cut(links.join(second, "next").select("_at", F.col("_far").alias("next")))
        release(reached, links)
        reached, links = wider, farther
    return reached


def _apply(on_file: dict, row: tuple) -> bool:
    """A stored credential, or a command that replaces the one on file."""
    stored, provider, sub, new_provider, new_sub = row
    if stored:
        on_file[provider] = sub
        return False
    if None in (provider, sub) or on_file.get(provider) != sub:
        return False
    on_file[new_provider] = new_sub
    return True


def _stepwise(credentials: DataFrame, commands: DataFrame) -> DataFrame:
    """(_at) of the accepted commands of users who also change providers.

    Each user's commands are read once in order, after the stored credentials; a task holds one user's credentials.
    """
    stored = credentials.select(
        "user_id", F.lit(None).cast(commands.schema["_at"].dataType).alias("_at"), F.lit(True).alias("stored"),
        F.col("provider_name").alias("old_provider"), F.col("sub").alias("old_sub"),
        F.lit(None).cast("string").alias("new_provider"), F.lit(None).cast("string").alias("new_sub"),
    )
    asked = commands.select("user_id", "_at", F.lit(False).alias("stored"), *CHANGE)
    return passes.pass_over(stored.unionByName(asked), "user_id", ["_at"], dict, _apply, ["stored", *CHANGE], ["_at"])


def update_credentials(
    credentials: DataFrame, commands: DataFrame, now: str | None = None, new_id=None
) -> tuple[DataFrame, DataFrame]:
    """Verify the old credential, then store the new one, as if applied in ``seq`` order.

    ``credentials`` has user_id, provider_name, sub and any other columns; ``commands`` is (seq, user_id, old_provider,
    old_sub, new_provider, new_sub). Returns the credentials, with all columns, and the commands with ``outcome``
    (missing_seq, auth or stored). Commands of one ``seq`` apply in the order of a hash of the command. Of the other columns, rows stored anew get ``updated_at``, and new rows ``inserted_at`` and ``id``
    (``new_id`` may use user_id and provider_name).
    """
    commands = passes.in_turn(commands)
    placed = commands.where("_at is not null")
    changers = placed.where(~F.col("old_provider").eqNullSafe(F.col("new_provider"))).select("user_id").distinct()
    changers = cut(changers)
    steady = split_join(placed, changers, ["user_id"], "left_anti")
    moving = split_join(placed, changers, ["user_id"], "left_semi")
    theirs = credentials.join(changers, "user_id", "left_semi")
    accepted = cut(_chained(credentials, steady).unionByName(_stepwise(theirs, moving)))
    judged = cut(
        commands.join(accepted.withColumn("_ok", F.lit(True)), "_at", "left")
        .withColumn("outcome", F.when(F.col("_ok"), "stored").when(F.col("_at").isNull(), "missing_seq").otherwise("auth"))
        .drop("_ok")
    )
    last = (
        judged.where("outcome = 'stored'")
        .groupBy("user_id", F.col("new_provider").alias("provider_name"))
        .agg(F.max_by("new_sub", "_at").alias("_sub"))
    )
    made_id = stable_id("credential", "user_id", "provider_name") if new_id is None else new_id
    old = credentials.withColumn("_old", F.lit(True))
    both = old.join(last, KEY, "full")
    fresh, created = F.col("_sub").isNotNull(), F.col("_old").isNull()
    new = {"sub": F.coalesce("_sub", "sub")}
    for column, value, when in (("updated_at", stamp(now), fresh), ("inserted_at", stamp(now), created), ("id", made_id, created)):
        if column in credentials.columns:
            new[column] = F.when(when, value).otherwise(F.col(column))
    return both.withColumns(new).select(*credentials.columns), judged.drop("_at")
