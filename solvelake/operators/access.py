"""Membership, credentials and admission of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvelake.operators import passes
from solvelake.operators.joins import split_join
from solvelake.session import cut, release

CREDENTIAL = ["user_id", "sub", "provider"]


def membership(claims: DataFrame, users: DataFrame) -> DataFrame:
    """``claims`` (user_id, team_id, ...) with ``membership``: does_not_exist, not_on_team or is_on_team."""
    u = users.select(F.col("id").alias("user_id"), F.col("team_id").alias("_team"), F.lit(True).alias("_user"))
    outcome = (
        F.when(F.col("_user").isNull(), "does_not_exist")
        .when(F.col("_team") == F.col("team_id"), "is_on_team")
        .otherwise("not_on_team")
    )
    return claims.join(u, "user_id", "left").withColumn("membership", outcome).drop("_team", "_user")


def _counts(credentials: DataFrame, keys: list[str], as_: str) -> DataFrame:
    c = credentials.withColumnRenamed("provider_name", "provider").dropna(subset=keys)
    return c.groupBy(*keys).agg(F.count(F.lit(1)).alias(as_))


def oauth_matches(requests: DataFrame, credentials: DataFrame) -> DataFrame:
    """``requests`` (user_id, sub, provider, ...) with ``matches``: the credential is on file."""
    known = _counts(credentials, CREDENTIAL, "_n")
    return (
        split_join(requests, known, CREDENTIAL)
        .withColumn("matches", F.col("_n").isNotNull())
        .drop("_n")
    )


def signin_outcomes(requests: DataFrame, credentials: DataFrame) -> DataFrame:
    """``requests`` with ``outcome``: not_found (user has no credential), bad_auth or authenticated."""
    any_ = _counts(credentials, ["user_id"], "_any")
    exact = _counts(credentials, CREDENTIAL, "_exact")
    outcome = (
        F.when(F.col("_any").isNull(), "not_found")
        .when(F.coalesce("_exact", F.lit(0)) != 1, "bad_auth")
        .otherwise("authenticated")
    )
    both = split_join(split_join(requests, any_, ["user_id"]), exact, CREDENTIAL)
    return both.withColumn("outcome", outcome).drop("_any", "_exact")


def admit(claims: DataFrame, users: DataFrame, challenges: DataFrame) -> DataFrame:
    """Solve claims (user_id, team_id, challenge_id, auth_ok, ...) with ``outcome``.

    The first failing check names the outcome: does_not_exist, not_on_team, bad_auth, unknown_challenge; else accepted.
    """
    known = challenges.select(F.col("id").alias("challenge_id"), F.lit(True).alias("_chall"))
    outcome = (
        F.when(F.col("membership") != "is_on_team", F.col("membership"))
        .when(~F.coalesce("auth_ok", F.lit(False)), "bad_auth")
        .when(F.col("_chall").isNull(), "unknown_challenge")
        .otherwise("accepted")
    )
    return (
        membership(claims, users)
        .join(known, "challenge_id", "left")
        .withColumn("outcome", outcome)
        .drop("_chall", "membership")
    )


def _may_hand_on(admins: set, row: tuple) -> bool:
    """A known admin, or a command whose actor is admin by then and makes its target one."""
    actor, target = row
    if target in admins or (actor is not None and actor not in admins):
        return False
    admins.add(target)
    return actor is not None


def admins_since(commands: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, since): the place ``_at`` of the command that makes each user an admin; null for those who are.

    ``commands`` has a total order ``_at`` (see ``passes.in_turn``). A promotion counts if its actor is admin before it.
    Commands of those who are admins already need no order. The others form groups of connected users; a group in
    which nobody is made admin from outside drops out, and each other one is read once in order. Groups of more than
    ``passes.GROUP`` commands hand rights on round by round.
    """
    known = users.select(F.col("id").alias("target_id"), F.col("admin").alias("_is"))
    usable = commands.where("auth_ok and _at is not null").join(known, "target_id")
    usable = usable.where("not coalesce(_is, false)").select("_at", "admin_id", "target_id")
    chiefs = users.where("admin").select(F.col("id").alias("admin_id"), F.lit(True).alias("_chief"))
    marked = cut(usable.join(chiefs, "admin_id", "left"))
    first = cut(marked.where("_chief").groupBy("target_id").agg(F.min("_at").alias("since")))
    later = split_join(marked.where("_chief is null"), first, ["target_id"]).where("since is null or _at < since")
    # A command more of one actor for one target changes nothing unless the actor became admin in between.
    later = cut(later.select("_at", "admin_id", "target_id").where("admin_id <> target_id"))
    linked = later.withColumns({"_u": passes.node("user", "admin_id"), "_v": passes.node("user", "target_id")})
    of = cut(passes.groups(linked, "_u", "_v"))
    seeds = first.withColumn("node", passes.node("user", "target_id")).join(of, "node")
    seeds = cut(seeds.select("group", F.col("since").alias("_at"), F.lit(None).cast(dict(users.dtypes)["id"]).alias("admin_id"), "target_id"))
    alive = seeds.groupBy("group").agg(F.lit(True).alias("_alive"))
    grouped = split_join(linked, of.withColumnRenamed("node", "_u"), ["_u"], "inner").select("group", "_at", "admin_id", "target_id")
    grouped = cut(split_join(grouped, alive, ["group"], "inner").drop("_alive"))
    sizes = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    events = cut(split_join(grouped.unionByName(seeds), sizes, ["group"], "inner"))
    read = ["admin_id", "target_id"]
    fits = events.where(F.col("_n") <= passes.GROUP)
    made = passes.pass_over(fits, "group", ["_at"], set, _may_hand_on, read, ["target_id", "_at"])
    large = _round_by_round(events.where(F.col("_n") > passes.GROUP))
    won = first.unionByName(made.withColumnRenamed("_at", "since")).unionByName(large)
    won = won.groupBy(F.col("target_id").alias("user_id")).agg(F.min("since").alias("since"))
    return won.unionByName(
        users.where("admin").select(F.col("id").alias("user_id"), F.lit(None).cast(won.schema["since"].dataType).alias("since"))
    )


def _round_by_round(events: DataFrame) -> DataFrame:
    """(target_id, since) of users that become admins by ``events``; those without an actor are given."""
    usable = cut(events.where("admin_id is not null").select("_at", "admin_id", "target_id"))
    frontier = cut(events.where("admin_id is null").select("target_id", F.col("_at").alias("since")))
    since = frontier
    while not frontier.isEmpty():
        actors = frontier.select(F.col("target_id").alias("admin_id"), "since")
        granted = split_join(usable, actors, ["admin_id"], "inner").where("since < _at")
        granted = granted.groupBy("target_id").agg(F.min("_at").alias("since"))
        before = since.withColumnRenamed("since", "_was")
        lowered = granted.join(before, "target_id", "left").where("_was is null or since < _was")
        lowered = cut(lowered.select("target_id", "since"))
        folded = cut(since.unionByName(lowered).groupBy("target_id").agg(F.min("since").alias("since")))
        release(frontier, since)
        frontier, since = lowered, folded
    return since


def promotions(commands: DataFrame, users: DataFrame) -> DataFrame:
    """Promotion commands (seq, admin_id, target_id, auth_ok) with ``outcome``, as if applied in ``seq`` order.

    Checks in order: missing_seq (null), auth (bad credential), does_not_exist (actor), auth (actor is no admin by
    then), does_not_exist (target); else promoted. Commands of one ``seq`` apply in the order of a hash of the command.
    """
    commands = passes.in_turn(commands)
    since = admins_since(commands, users).select(F.col("user_id").alias("admin_id"), "since", F.lit(True).alias("_admin"))
    actors = users.select(F.col("id").alias("admin_id"), F.lit(True).alias("_actor"))
    targets = users.select(F.col("id").alias("target_id"), F.lit(True).alias("_target"))
    outcome = (
        F.when(F.col("_at").isNull(), "missing_seq")
        .when(~F.coalesce("auth_ok", F.lit(False)), "auth")
        .when(F.col("_actor").isNull(), "does_not_exist")
        .when(F.col("_admin").isNull() | (F.col("since") >= F.col("_at")), "auth")
        .when(F.col("_target").isNull(), "does_not_exist")
        .otherwise("promoted")
    )
    return (
        split_join(commands, since, ["admin_id"])
        .join(actors, "admin_id", "left")
        .join(targets, "target_id", "left")
        .withColumn("outcome", outcome)
        .drop("since", "_admin", "_actor", "_target", "_at")
    )
