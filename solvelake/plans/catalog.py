"""Catalogues, lookups and name checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvelake.operators import catalog, scores
from solvelake.plans.leaderboard import scored_teams
from solvelake.plans.registry import query
from solvelake.schemas import LINK_TYPES
from solvelake.sources import testbed as tb


def joined(col: str):
    """Arrays as text, so that the comparison does not depend on list types."""
    return F.array_join(col, "|").alias(col)


@query(
    "challenges_with_links",
    f"""
    select c.id, c.name, c.points, array_to_string(c.categories, '|') categories, c.visible, c.source_folder,
           {", ".join(f"coalesce(array_to_string(list_sort(list(l.url) filter (where l.type = '{t}')), '|'), '') links_{t}" for t in LINK_TYPES)},
           (select count(s.attempt_id) from successes s where s.challenge_id = c.id) solve_count
    from challenges c left join links l on l.challenge_id = c.id
    group by all
    """,
)
def challenges_with_links(spark, sf):
    c = tb.challenges(spark, sf)
    counts = scores.solve_counts(c, tb.successes(spark, sf)).withColumnRenamed("challenge_id", "id")
    out = catalog.challenge_catalog(c.join(counts, "id"), tb.links(spark, sf))
    return out.select(
        "id", "name", "points", joined("categories"), "visible", "source_folder", "solve_count",
        *[joined(f"links_{t}") for t in LINK_TYPES],
    )


@query("links_of_type", "select challenge_id, url from links where type = 'web'")
def links_of_type(spark, sf):
    return catalog.links_of_type(tb.links(spark, sf), "web")


@query(
    "teams_public",
    "select id, name, score, cast(epoch(last_solve) as bigint) last_solve, eligible, affiliation from scored_teams",
)
def teams_public(spark, sf):
    return catalog.public_teams(scored_teams(spark, sf))


@query(
    "users_public",
    """
    select u.id, u.email, u.name, u.team_id, u.eligible, u.admin,
           cast(coalesce((select sum(c.points) from successes s join challenges c on c.id = s.challenge_id
                          where s.user_id = u.id), 0) as bigint) score,
           (select cast(epoch(max(s.solved_at)) as bigint) from successes s where s.user_id = u.id) last_solve
    from users u
    """,
)
def users_public(spark, sf):
    u = scores.with_scores(tb.users(spark, sf), tb.successes(spark, sf), tb.challenges(spark, sf), "user_id")
    return catalog.public_users(u)


@query(
    "lookup_by_id",
    """
    select o.o_orderkey id, u.id is not null found, u.name, u.team_id
    from orders o left join users u on u.id = o.o_orderkey
    """,
)
def lookup_by_id(spark, sf):
    """Order keys as requested user ids; most are unknown."""
    ids = tb.raw(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return catalog.lookup(ids, tb.users(spark, sf).select("id", "name", "team_id"))


@query(
    "lookup_solves_by_id",
    """
    select o.o_orderkey id, a.id is not null found, a.team_id, a.correct, s.attempt_id is not null counted
    from orders o left join attempts a on a.id = o.o_orderkey left join successes s on s.attempt_id = a.id
    """,
)
def lookup_solves_by_id(spark, sf):
    from solvelake.operators import ledger

    ids = tb.raw(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    s = ledger.solves(tb.attempts(spark, sf), tb.successes(spark, sf)).select("id", "team_id", "correct", "counted")
    return catalog.lookup(ids, s).withColumn("counted", F.coalesce("counted", F.lit(False)))


@query(
    "lookup_by_name_ci",
    """
    select o.o_orderkey seq, 'CUSTOMER#' || lpad(cast(o.o_orderkey as varchar), 9, '0') name,
           u.name stored_name, u.id, u.id is not null found
    from orders o left join users u
      on lower(u.name) = lower('CUSTOMER#' || lpad(cast(o.o_orderkey as varchar), 9, '0'))
    """,
)
def lookup_by_name_ci(spark, sf):
    asked = F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    wanted = tb.raw(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), asked.alias("name"))
    return catalog.lookup_by_name(wanted, tb.users(spark, sf).select("id", "name"))


@query(
    "name_availability",
    """
    select o_orderkey seq, 'SUPPLIER#' || lpad(cast(o_custkey as varchar), 9, '0') name,
           not exists (select 1 from teams t
             where lower(t.name) = lower('SUPPLIER#' || lpad(cast(o_custkey as varchar), 9, '0'))) available
    from orders
    """,
)
def name_availability(spark, sf):
    asked = F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    names = tb.raw(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), asked.alias("name"))
    return catalog.name_available(names, tb.teams(spark, sf))


@query(
    "folder_resolution",
    """
    select o_orderkey seq, 'chall/' || cast(o_orderkey as varchar) source_folder,
           (select c.id from challenges c where c.source_folder = 'chall/' || cast(o_orderkey as varchar)) challenge_id,
           (select c.source_folder from challenges c where c.id = o_custkey) folder_of_id
    from orders
    """,
)
def folder_resolution(spark, sf):
    """Folder to id, and id to folder, for one folder and one id per order."""
    asked = tb.raw(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("chall/"), F.col("o_orderkey").cast("string")).alias("source_folder"),
        F.col("o_custkey").alias("asked_id"),
    )
    c = tb.challenges(spark, sf).select("id", "source_folder")
    out = catalog.folder_to_id(asked, c)
    back = catalog.id_to_folder(
        asked.select("seq", F.col("asked_id").alias("challenge_id")), c
    ).select("seq", F.col("source_folder").alias("folder_of_id"))
    return out.join(back, "seq").select("seq", "source_folder", "challenge_id", "folder_of_id")
