"""Constraint checks over tables with natural faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvelake import schemas
from solvelake.operators import ledger, quality, scores
from solvelake.plans.registry import query
from solvelake.sources import testbed as tb


@query(
    "dup_keys",
    """
    select 'challenges' "table", 'name' "key", lower(p_name) "value", count(*) n from part
    group by lower(p_name) having count(*) > 1
    union all
    select 'users', 'email', lower(c_mktsegment) || '@' || cast(c_nationkey as varchar), count(*) from customer
    group by lower(c_mktsegment), c_nationkey having count(*) > 1
    union all
    select 'users', 'name', lower(c_name), count(*) from customer group by lower(c_name) having count(*) > 1
    union all
    select 'challenge_links', 'challenge_id,url', cast(challenge_id as varchar) || ',' || url, count(*) from links
    group by challenge_id, url having count(*) > 1
    """,
)
def dup_keys(spark, sf):
    """Plain part names repeat, and so do emails made of segment and nation."""
    p = tb.raw(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("chall/"), F.col("p_partkey").cast("string")).alias("source_folder"),
    )
    u = tb.raw(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat("c_mktsegment", F.lit("@"), F.col("c_nationkey").cast("string")).alias("email"),
    )
    return (
        quality.table_duplicates(p, "challenges")
        .unionByName(quality.table_duplicates(u, "users"))
        .unionByName(quality.table_duplicates(tb.links(spark, sf), "challenge_links"))
    )


ORPHAN = """
select '{c}' child, '{col}' "column", '{p}' parent, count(*) n
from {src} x where x.{col} is not null and x.{col} not in (select id from {psrc})
"""


@query(
    "orphans",
    " union all ".join(
        ORPHAN.format(c=c, col=col, p=p, src=src, psrc=psrc)
        for c, col, p, src, psrc in [
            ("challenge_links", "challenge_id", "challenges", "links", "seen"),
            ("users", "team_id", "teams", "users", "fit"),
            ("solve_attempts", "challenge_id", "challenges", "attempts", "seen"),
            ("solve_attempts", "team_id", "teams", "attempts", "fit"),
            ("solve_attempts", "user_id", "users", "attempts", "users"),
            ("solve_successes", "attempt_id", "solve_attempts", "successes", "attempts"),
            ("solve_successes", "challenge_id", "challenges", "successes", "seen"),
            ("solve_successes", "team_id", "teams", "successes", "fit"),
            ("solve_successes", "user_id", "users", "successes", "users"),
            ("auth_oauth", "user_id", "users", "credentials", "users"),
        ]
    ),
    """
    seen as (select * from challenges where visible),
    fit as (select * from teams where eligible)
    """,
)
def orphans(spark, sf):
    """Hidden challenges and ineligible teams are left out of the parents."""
    a = tb.stored_attempts(spark, sf)
    return quality.all_orphans(
        {
            "teams": tb.teams(spark, sf).where("eligible"),
            "challenges": tb.challenges(spark, sf).where("visible"),
            "users": tb.users(spark, sf),
            "challenge_links": tb.links(spark, sf),
            "solve_attempts": a,
            "solve_successes": ledger.first_correct(a),
            "auth_oauth": tb.credentials(spark, sf),
        }
    )


@query(
    "null_violations",
    """
    select 'id' "column", count(*) filter (where id is null) n from u union all
    select 'email', count(*) filter (where email is null) from u union all
    select 'name', count(*) filter (where name is null) from u union all
    select 'eligible', count(*) filter (where eligible is null) from u union all
    select 'admin', count(*) filter (where admin is null) from u
    """,
    """
    u as (select id, case when eligible then email end email, case when not admin then name end name, eligible,
                 case when team_id is not null then admin end admin from users)
    """,
)
def null_violations(spark, sf):
    u = tb.users(spark, sf).select(
        "id",
        F.when(F.col("eligible"), F.col("email")).alias("email"),
        F.when(~F.col("admin"), F.col("name")).alias("name"),
        "team_id",
        "eligible",
        F.when(F.col("team_id").isNotNull(), F.col("admin")).alias("admin"),
    )
    return quality.null_violations(u, "users")


@query(
    "domain_violations",
    """
    select 'challenge_links' "table", 'type' "column",
           count(*) filter (where case when length(html) > 2000 then 'ftp' else 'web' end
                                     not in ('nc', 'web', 'admin', 'static')) n
    from pages
    union all
    select 'solve_attempts', 'flag_guess', count(*) filter (where length(text) > 255) from documents
    """,
)
def domain_violations(spark, sf):
    """Long pages get a link type that does not exist; whole documents are taken as guesses."""
    links = tb.raw(spark, sf, "pages").select(
        F.when(F.char_length("html") > 2000, "ftp").otherwise("web").alias("type")
    )
    guesses = tb.raw(spark, sf, "documents").select(F.col("text").alias("flag_guess"))
    one = quality.domain_violations(links, "challenge_links").select(F.lit("challenge_links").alias("table"), "*")
    two = quality.domain_violations(guesses, "solve_attempts").select(F.lit("solve_attempts").alias("table"), "*")
    return one.unionByName(two)


@query(
    "enum_violations",
    """
    select 'status' "column", count(*) filter (where status not in ('started', 'building', 'pulling', 'pushing',
             'uploading', 'success', 'failure', 'unknown')) n from codes union all
    select 'level', count(*) filter (where level not in ('INFO', 'WARN', 'ERROR')) from codes union all
    select 'sync', count(*) filter (where sync not in ('chall', 'all_challs', 'user', 'all_users', 'team',
             'all_teams', 'solves', 'all')) from codes
    """,
    """
    codes as (
      select case event_type when 'click' then 'building' when 'purchase' then 'success' else event_type end status,
             case when value < 20 then 'INFO' when value < 200 then 'WARN' else 'FATAL' end level,
             case when event_type = 'view' then 'all_teams' when event_type = 'error' then 'none' else 'all' end sync
      from events)
    """,
)
def enum_violations(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    codes = tb.raw(spark, sf, "events").select(
        F.when(kind == "click", "building").when(kind == "purchase", "success").otherwise(kind).alias("status"),
        F.when(value < 20, "INFO").when(value < 200, "WARN").otherwise("FATAL").alias("level"),
        F.when(kind == "view", "all_teams").when(kind == "error", "none").otherwise("all").alias("sync"),
    )
    return quality.enum_violations(
        codes,
        {"status": schemas.DEPLOY_STATUSES, "level": schemas.ALERT_LEVELS, "sync": schemas.SYNC_TYPES},
    )


@query(
    "ledger_drift",
    """
    select * from (
      select 'team' kind, t.id,
        cast(coalesce((select sum(c.points) from early s join challenges c on c.id = s.challenge_id
                       where s.team_id = t.id), 0) as bigint) stored, t.score derived
      from scored_teams t
      union all
      select 'challenge', c.id, (select count(*) from early s where s.challenge_id = c.id),
        (select count(*) from successes s where s.challenge_id = c.id)
      from challenges c)
    where stored <> derived
    """,
    "early as (select * from successes where solved_at < timestamp '2024-01-15 00:00:00')",
)
def ledger_drift(spark, sf):
    """Scores and solve counts stored at half time against the whole ledger."""
    led, c = tb.stored_ledger(spark, sf), tb.challenges(spark, sf)
    early = led.where(F.col("solved_at") < F.lit(tb.START).cast("timestamp_ntz"))
    teams = scores.with_scores(tb.teams(spark, sf), early, c, "team_id")
    counts = scores.solve_counts(c, early).withColumnRenamed("challenge_id", "id")
    drift = quality.score_drift(teams, led, c, "team_id").select(F.lit("team").alias("kind"), "*")
    more = quality.count_drift(counts, led).select(F.lit("challenge").alias("kind"), "*")
    return drift.unionByName(more)


@query(
    "ledger_faults",
    """
    select a.id attempt_id,
           case when a.event_type <> 'purchase' then 'not_correct' else 'other_team_id' end fault
    from (select e.event_id id, e.event_type, u.team_id, e.user_id
          from events e join users u on u.id = e.user_id where u.team_id is not null) a
    where a.event_type = 'error' or (a.event_type = 'purchase' and a.team_id < 10)
    """,
)
def ledger_faults(spark, sf):
    """A ledger with errors booked as solves and with some teams off by one."""
    kinds = tb.raw(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    a = tb.attempts(spark, sf)
    bad = (
        a.join(kinds, "id")
        .where("event_type in ('purchase', 'error')")
        .select(
            F.col("id").alias("attempt_id"),
            "user_id",
            "challenge_id",
            F.when(F.col("team_id") < 10, F.col("team_id") + 1).otherwise(F.col("team_id")).alias("team_id"),
            F.col("inserted_at").alias("solved_at"),
        )
    )
    return quality.ledger_faults(bad, a)
