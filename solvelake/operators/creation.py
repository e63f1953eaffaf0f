"""New teams and users: names are unique in any case, also among the commands of one batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvelake.functions.common import fold, stable_id, stamp
from solvelake.operators import passes
from solvelake.operators.joins import split_join
from solvelake.session import cut, release


def _free(taken: tuple[set, set], row: tuple) -> bool:
    """Take both keys if both are free."""
    left, right = row
    if left in taken[0] or right in taken[1]:
        return False
    taken[0].add(left)
    taken[1].add(right)
    return True


def _in_rounds(open_: DataFrame, left: str, right: str, patient: bool) -> tuple[list[DataFrame], DataFrame]:
    """Accepted claims, and those left open once a round settles less than a quarter (never, if ``patient``).

    Every round accepts the claims that come first for both of their keys and drops the others on those keys. The
    earliest open claim always qualifies. Taking the first claim per key in one pass would be wrong: a claim that
    loses on one key must not block its other key.
    """
    taken: list[DataFrame] = []
    n = open_.count()
    while n:
        by_left = open_.groupBy(left).agg(F.min("_at").alias("_at"))
        by_right = open_.groupBy(right).agg(F.min("_at").alias("_at"))
        won = cut(open_.join(by_left, [left, "_at"]).join(by_right, [right, "_at"]).select("_at", left, right))
        taken.append(won)
        if len(taken) == 16:
            folded = cut(reduce(DataFrame.unionByName, taken))
            release(*taken)
            taken = [folded]
        rest = cut(
            split_join(split_join(open_, won.select(left), [left], "left_anti"), won.select(right), [right], "left_anti")
            .select("_at", left, right)
        )
        release(open_)
        before, n, open_ = n, rest.count(), rest
        if not patient and 4 * n > 3 * before:
            break
    return taken, open_


def first_come(claims: DataFrame, left: str, right: str) -> DataFrame:
    """Accept claims (``_at``, left, right) in the order of ``_at``, each if both of its keys are still free.

    ``_at`` is a total order (see ``passes.in_turn``). A claim with a null key or a null place is never accepted.

    Claims that are alone on both keys are settled first. Contested ones go through rounds of joins as long as a round
    settles a quarter of them, which takes a logarithmic number of rounds. What is left waits in chains: its groups of
    connected keys are found, and each is read once in order (groups of more than ``passes.GROUP`` claims go on in
    rounds).
    """
    whole = claims.select("_at", left, right).dropna(subset=["_at", left, right])
    rivals = [whole.groupBy(k).agg(F.count(F.lit(1)).alias(n)) for k, n in ((left, "_l"), (right, "_r"))]
    counted = cut(split_join(split_join(whole, rivals[0], [left]), rivals[1], [right]))
    alone = (F.col("_l") == 1) & (F.col("_r") == 1)
    taken = [counted.where(alone).select("_at", left, right)]
    won, open_ = _in_rounds(cut(counted.where(~alone).select("_at", left, right)), left, right, patient=False)
    taken += won
    if not open_.isEmpty():
        linked = open_.withColumns({"_u": passes.node("left", left), "_v": passes.node("right", right)})
        of = cut(passes.groups(linked, "_u", "_v").withColumnRenamed("node", "_u"))
        grouped = cut(split_join(linked, of, ["_u"], "inner").select("_at", left, right, "group"))
        sizes = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
        sized = cut(split_join(grouped, sizes, ["group"], "inner"))
        fits = sized.where(F.col("_n") <= passes.GROUP)
        taken.append(cut(
            passes.pass_over(fits, "group", ["_at"], lambda: (set(), set()), _free, [left, right], ["_at", left, right])
        ))
        large = cut(sized.where(F.col("_n") > passes.GROUP).select("_at", left, right))
        taken += _in_rounds(large, left, right, patient=True)[0]
    return reduce(DataFrame.unionByName, taken)


def _holder(accepted: DataFrame, key: str, as_: str) -> DataFrame:
    return accepted.select(key, F.col("_at").alias(as_))


def create_teams(
    teams: DataFrame, users: DataFrame, commands: DataFrame, now: str | None, new_id: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Create teams with their founder as first member.

    ``commands`` is (seq, name, description, eligible, affiliation, founder_id, auth_ok). Checks in order: missing_name
    (null), missing_seq (null), name_taken, does_not_exist (founder), already_on_team, auth; else created. Commands
    apply in ``seq`` order; those of one ``seq`` in the order of a hash of the command, and of equal commands one is
    created. Returns teams, users and the commands with ``outcome`` and ``team_id``.
    """
    stored = teams.select(fold("name").alias("name_key"), F.lit(True).alias("_stored"))
    founders = users.select(
        F.col("id").alias("founder_id"), F.lit(True).alias("_user"), F.col("team_id").alias("_team")
    )
    known = cut(
        passes.in_turn(commands).withColumn("name_key", fold("name"))
        .join(stored, "name_key", "left")
        .join(founders, "founder_id", "left")
    )
    may = known.where("_stored is null and _user and _team is null and auth_ok")
    accepted = cut(first_come(may, "name_key", "founder_id"))
    by_name = split_join(known, _holder(accepted, "name_key", "_name_at"), ["name_key"])
    both = split_join(by_name, _holder(accepted, "founder_id", "_founder_at"), ["founder_id"])
    outcome = (
        F.when(F.col("name").isNull(), "missing_name")
        .when(F.col("seq").isNull(), "missing_seq")
        .when(F.col("_stored") | (F.col("_name_at") < F.col("_at")), "name_taken")
        .when(F.col("_user").isNull(), "does_not_exist")
        .when(F.col("_team").isNotNull() | (F.col("_founder_at") < F.col("_at")), "already_on_team")
        .when(~F.coalesce("auth_ok", F.lit(False)), "auth")
        .otherwise("created")
    )
    made_id = stable_id("team", "name_key") if new_id is None else new_id
    judged = both.withColumn("outcome", outcome).withColumn("team_id", F.when(outcome == "created", made_id))
    judged = cut(judged.drop("_stored", "_user", "_team", "_name_at", "_founder_at", "name_key", "_at"))

    made = judged.where("outcome = 'created'")
    new_teams = made.select(
        F.col("team_id").alias("id"), "name", "description", "eligible", "affiliation",
        F.lit(0).alias("score"), F.lit(None).cast("timestamp_ntz").alias("last_solve"),
        stamp(now).alias("inserted_at"), stamp(now).alias("updated_at"),
    )
    moves = made.select(F.col("founder_id").alias("id"), F.col("team_id").alias("_new"))
    moved = (
        users.join(moves, "id", "left")
        .withColumn("team_id", F.coalesce("_new", "team_id"))
        .withColumn("updated_at", F.when(F.col("_new").isNotNull(), stamp(now)).otherwise(F.col("updated_at")))
        .select(*users.columns)
    )
    return teams.unionByName(new_teams, allowMissingColumns=True).select(*teams.columns), moved, judged


def create_users(
    users: DataFrame, credentials: DataFrame, commands: DataFrame, now: str | None, new_id: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Create users with their credential; name and email are unique.

    ``commands`` is (seq, name, email, eligible, admin, sub, provider). Returns users, credentials and the commands
    with ``outcome``: missing_name, missing_email or missing_seq (null), name_taken, email_taken or created. Commands
    of one ``seq`` apply in the order of a hash of the command.
    """
    names = users.select(fold("name").alias("name_key"), F.lit(True).alias("_name"))
    emails = users.select(fold("email").alias("email_key"), F.lit(True).alias("_email"))
    known = cut(
        passes.in_turn(commands).withColumn("name_key", fold("name"))
        .withColumn("email_key", fold("email"))
        .join(names, "name_key", "left")
        .join(emails, "email_key", "left")
    )
    accepted = cut(first_come(known.where("_name is null and _email is null"), "name_key", "email_key"))
    by_name = split_join(known, _holder(accepted, "name_key", "_name_at"), ["name_key"])
    both = split_join(by_name, _holder(accepted, "email_key", "_email_at"), ["email_key"])
    outcome = (
        F.when(F.col("name").isNull(), "missing_name")
        .when(F.col("email").isNull(), "missing_email")
        .when(F.col("seq").isNull(), "missing_seq")
        .when(F.col("_name") | (F.col("_name_at") < F.col("_at")), "name_taken")
        .when(F.col("_email") | (F.col("_email_at") < F.col("_at")), "email_taken")
        .otherwise("created")
    )
    made_id = stable_id("user", "name_key") if new_id is None else new_id
    judged = both.withColumn("outcome", outcome).withColumn("user_id", F.when(outcome == "created", made_id))
    judged = cut(judged.drop("_name", "_email", "_name_at", "_email_at", "name_key", "email_key", "_at"))

    made = judged.where("outcome = 'created'")
    new_users = made.select(
        F.col("user_id").alias("id"), "name", "email", "eligible", "admin",
        F.lit(0).alias("score"), stamp(now).alias("inserted_at"), stamp(now).alias("updated_at"),
    )
    new_credentials = made.select(
        "user_id", F.col("provider").alias("provider_name"), "sub",
        stamp(now).alias("inserted_at"), stamp(now).alias("updated_at"),
    )
    if "id" in credentials.columns:
        new_credentials = new_credentials.withColumn("id", stable_id("credential", "user_id", "provider_name"))
    all_users = users.unionByName(new_users, allowMissingColumns=True).select(*users.columns)
    all_credentials = credentials.unionByName(new_credentials, allowMissingColumns=True).select(*credentials.columns)
    return all_users, all_credentials, judged
