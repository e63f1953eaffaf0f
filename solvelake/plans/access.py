"""Sign-in, membership, admission, promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvelake.operators import access, attempts, ledger, refresh
from solvelake.plans.registry import query
from solvelake.session import work_path
from solvelake.sources import buckets
from solvelake.sources import testbed as tb

# Claims with a named team, user and challenge of which some are wrong: cheap events name a user that does not exist,
# errors name no team of theirs, dear ones a challenge that does not exist.
CLAIMS = """
asks as (
  select c.id, case when e.value < 1 then -1 - c.user_id else c.user_id end user_id,
         case when e.event_type = 'error' then -1 else coalesce(u.team_id, 0) end team_id,
         case when e.value > 40 then -1 - c.challenge_id else c.challenge_id end challenge_id,
         e.event_type <> 'click' auth_ok
  from claims c join events e on e.event_id = c.id left join users u on u.id = c.user_id)
"""


def asks(spark, sf):
    e = tb.raw(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type", "value")
    u = tb.users(spark, sf).select(F.col("id").alias("user_id"), "team_id")
    flip = lambda col: -1 - F.col(col)
    return (
        tb.claims(spark, sf)
        .join(e, "id")
        .join(u, "user_id", "left")
        .select(
            "id",
            F.when(F.col("value") < 1, flip("user_id")).otherwise(F.col("user_id")).alias("user_id"),
            F.when(F.col("event_type") == "error", -1).otherwise(F.coalesce("team_id", F.lit(0))).alias("team_id"),
            F.when(F.col("value") > 40, flip("challenge_id")).otherwise(F.col("challenge_id")).alias("challenge_id"),
            (F.col("event_type") != "click").alias("auth_ok"),
        )
    )


@query(
    "signin_outcomes",
    """
    select s.id, case
      when (select count(*) from credentials c where c.user_id = s.user_id) = 0 then 'not_found'
      when (select count(*) from credentials c where c.user_id = s.user_id and c.sub = s.sub
              and c.provider_name = s.provider) <> 1 then 'bad_auth'
      else 'authenticated' end outcome
    from signins s
    """,
)
def signin_outcomes(spark, sf):
    return access.signin_outcomes(tb.signins(spark, sf), tb.credentials(spark, sf)).select("id", "outcome")


@query(
    "oauth_matches",
    """
    select s.id, (select count(*) from credentials c where c.user_id = s.user_id and c.sub = s.sub
                    and c.provider_name = s.provider) > 0 matches
    from signins s
    """,
)
def oauth_matches(spark, sf):
    return access.oauth_matches(tb.signins(spark, sf), tb.credentials(spark, sf)).select("id", "matches")


@query(
    "membership_outcomes",
    """
    select a.id, case when u.id is null then 'does_not_exist' when u.team_id = a.team_id then 'is_on_team'
                 else 'not_on_team' end membership
    from asks a left join users u on u.id = a.user_id
    """,
    CLAIMS,
)
def membership_outcomes(spark, sf):
    return access.membership(asks(spark, sf), tb.users(spark, sf)).select("id", "membership")


@query(
    "attempt_admission",
    """
    select a.id, case when u.id is null then 'does_not_exist'
                 when u.team_id is null or u.team_id <> a.team_id then 'not_on_team'
                 when not a.auth_ok then 'bad_auth'
                 when a.challenge_id not in (select id from challenges) then 'unknown_challenge'
                 else 'accepted' end outcome
    from asks a left join users u on u.id = a.user_id
    """,
    CLAIMS,
)
def attempt_admission(spark, sf):
    return access.admit(asks(spark, sf), tb.users(spark, sf), tb.challenges(spark, sf)).select("id", "outcome")


PROMOTIONS = """
commands as (
  select o_orderkey seq, o_custkey admin_id,
         cast(floor(o_totalprice) as bigint) % (select 2 * count(*) from customer) target_id,
         o_orderstatus <> 'F' auth_ok
  from orders),
reach as (
  select id, cast(-1 as bigint) since from users where admin
  union
  select c.target_id, c.seq from reach r join commands c on c.admin_id = r.id and r.since < c.seq
  where c.auth_ok and c.target_id in (select id from users))
"""


def promotion_commands(spark, sf):
    n = tb.raw(spark, sf, "customer").agg(2 * F.count(F.lit(1))).scalar()
    return tb.raw(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("admin_id"),
        (F.floor("o_totalprice").cast("bigint") % n).alias("target_id"),
        (F.col("o_orderstatus") != "F").alias("auth_ok"),
    )


@query(
    "promotions",
    """
    select c.seq, case when not c.auth_ok then 'auth'
      when c.admin_id not in (select id from users) then 'does_not_exist'
      when not exists (select 1 from reach r where r.id = c.admin_id and r.since < c.seq) then 'auth'
      when c.target_id not in (select id from users) then 'does_not_exist'
      else 'promoted' end outcome
    from commands c
    """,
    PROMOTIONS,
)
def promotions(spark, sf):
    return access.promotions(promotion_commands(spark, sf), tb.users(spark, sf)).select("seq", "outcome")


BATCH = """
booked as (
  select c.*, u.team_id, x.sub, x.provider_name
  from claims c join users u on u.id = c.user_id left join credentials x on x.user_id = u.id
  where c.inserted_at >= timestamp '2024-01-15 00:00:00'),
admitted as (select * from booked where team_id is not null and sub is not null),
old as (select * from successes where solved_at < timestamp '2024-01-15 00:00:00'),
right_ones as (
  select a.*, row_number() over (partition by a.challenge_id, a.team_id order by a.inserted_at, a.id) rn
  from admitted a join challenges c on c.id = a.challenge_id and c.flag = a.flag_guess
  where not exists (select 1 from old o where o.challenge_id = a.challenge_id and o.team_id = a.team_id)),
whole as (
  select team_id, challenge_id from old union all select team_id, challenge_id from right_ones where rn = 1)
"""


def half(spark, sf):
    """The claims of the second half, the tables after the first, its log and its ledger."""
    start = F.lit(tb.START).cast("timestamp_ntz")
    log = tb.stored_attempts(spark, sf)
    early = log.where(F.col("inserted_at") < start)
    old = ledger.first_correct(early)
    c = tb.challenges(spark, sf)
    u, t = tb.users(spark, sf), tb.teams(spark, sf)
    creds = tb.credentials(spark, sf)
    own = creds.select("user_id", F.col("provider_name").alias("provider"), "sub")
    claims = (
        tb.claims(spark, sf)
        .where(F.col("inserted_at") >= start)
        .join(u.select(F.col("id").alias("user_id"), "team_id"), "user_id")
        .join(own, "user_id", "left")
    )
    then = F.lit("2023-06-01 00:00:00").cast("timestamp_ntz")
    stored = {"score": F.lit(0).cast("bigint"), "last_solve": then, "updated_at": then}
    return (
        claims,
        creds,
        refresh.recompute_owners(u.withColumns(stored), old, c, "user_id"),
        refresh.recompute_owners(t.withColumns(stored), old, c, "team_id"),
        refresh.recompute_challenges(c.withColumns({"solve_count": F.lit(0).cast("bigint"), "updated_at": then}), old),
    ), early, old


def batch(spark, sf):
    """The claims of the second half, admitted, counted and scored on top of the first."""
    tables, log, old = half(spark, sf)
    return attempts.process(*tables, log, old, tb.NOW, -F.col("attempt_id"))


AFTER = """
    select t.id team_id, cast(coalesce((select sum(c.points) from whole w join challenges c on c.id = w.challenge_id
                                        where w.team_id = t.id), 0) as bigint) score,
           t.id in (select team_id from right_ones where rn = 1) touched
    from teams t
    """


def _teams_after(out):
    now = F.lit(tb.NOW).cast("timestamp_ntz")
    return out.teams.select(F.col("id").alias("team_id"), "score", (F.col("updated_at") == now).alias("touched"))


@query("attempt_batch", AFTER, BATCH)
def attempt_batch(spark, sf):
    """The teams after the batch."""
    return _teams_after(batch(spark, sf))


@query("attempt_batch_stored", AFTER, BATCH)
def attempt_batch_stored(spark, sf):
    """The teams after the batch, against a ledger in buckets."""
    tables, log, old = half(spark, sf)
    path = work_path(spark, "ledger-store")
    attempts.store_ledger(log, old, path, 8)
    return _teams_after(attempts.process_stored(*tables, path, 1, tb.NOW, -F.col("attempt_id"), 8))


@query("attempt_batch_ledger", "select attempt_id, team_id from old union all select id, team_id from right_ones where rn = 1", BATCH)
def attempt_batch_ledger(spark, sf):
    """The stored ledger after the batch, as its buckets of users have it."""
    tables, log, old = half(spark, sf)
    path = work_path(spark, "ledger-store")
    attempts.store_ledger(log, old, path, 8)
    attempts.process_stored(*tables, path, 1, tb.NOW, -F.col("attempt_id"), 8)
    return buckets.read(spark, f"{path}/user_id", "attempt_id bigint, team_id bigint")
