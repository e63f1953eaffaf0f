"""Upserts, patches, creation, credentials, refresh, clearing and cascades."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvelake.functions.common import epoch, stamp
from solvelake.operators import creation, credentials, ledger, patches, quality, refresh, removal, upserts
from solvelake.plans import access as access_plans
from solvelake.plans.registry import query
from solvelake.session import cut
from solvelake.sources import testbed as tb

OLD = "2023-06-01 00:00:00"


def stamped(df):
    return df.withColumns({"inserted_at": stamp(OLD), "updated_at": stamp(OLD)})


def touched():
    return (F.col("updated_at") == stamp(tb.NOW)).alias("touched")


def orders(spark, sf):
    return tb.raw(spark, sf, "orders").withColumnRenamed("o_orderkey", "seq")


# --- challenge upserts -------------------------------------------------------------------------------------------

UPSERTS = """
commands as (
  select o_orderkey seq,
         case when o_orderstatus = 'P' then -1000000000 - o_orderkey end id,
         'chall/' || cast(o_orderkey % ((select count(*) from part) + 50) as varchar) source_folder,
         'chall ' || cast(o_orderkey as varchar) name, cast(floor(o_totalprice / 1000) as int) points,
         o_orderpriority <> '5-LOW' visible,
         'http://c.example/' || cast(o_orderkey as varchar) web,
         case when o_orderpriority = '1-URGENT' then 'c.example ' || cast(o_custkey as varchar) end nc
  from orders),
pinned as (
  select id, source_folder from challenges
  where id in (select challenge_id from links) or id in (select challenge_id from attempts)),
judged as (
  select c.*, case when c.id <> p.id then 'id_in_use' else 'stored' end outcome
  from commands c left join pinned p on p.source_folder = c.source_folder),
lasts as (
  select *, (select b.id from judged b where b.outcome = 'stored' and b.source_folder = a.source_folder
             and b.id is not null order by b.seq desc limit 1) given
  from judged a
  where outcome = 'stored' and seq = (select max(b.seq) from judged b where b.outcome = 'stored'
                                      and b.source_folder = a.source_folder)),
merged as (
  select coalesce(l.given, c.id, -1 - cast(substr(l.source_folder, 7) as bigint)) id,
         coalesce(l.name, c.name) name, coalesce(l.points, c.points) points,
         coalesce(l.visible, c.visible) visible, coalesce(l.source_folder, c.source_folder) source_folder,
         l.seq is not null touched, l.web, l.nc
  from challenges c full join lasts l on l.source_folder = c.source_folder)
"""


def upserted(spark, sf, stored=True):
    n = tb.raw(spark, sf, "part").agg(F.count(F.lit(1)) + 50).scalar()
    seq = F.col("seq").cast("string")
    web = F.struct(F.lit("web").alias("type"), F.concat(F.lit("http://c.example/"), seq).alias("location"))
    nc = F.struct(
        F.lit("nc").alias("type"), F.concat(F.lit("c.example "), F.col("o_custkey").cast("string")).alias("location")
    )
    none = F.array().cast("array<string>")
    commands = orders(spark, sf).select(
        "seq",
        F.when(F.col("o_orderstatus") == "P", -1000000000 - F.col("seq")).alias("id"),
        F.concat(F.lit("chall/"), (F.col("seq") % n).cast("string")).alias("source_folder"),
        F.concat(F.lit("chall "), seq).alias("name"),
        F.lit("").alias("description"),
        F.lit("flag").alias("flag"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("points"),
        *[none.alias(c) for c in ("authors", "hints", "categories", "tags")],
        (F.col("o_orderpriority") != "5-LOW").alias("visible"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.array(web, nc)).otherwise(F.array(web)).alias("links"),
    )
    current = stamped(tb.challenges(spark, sf).withColumn("solve_count", F.lit(0)))
    made = -1 - F.substring("source_folder", 7, 20).cast("bigint")
    children = [tb.links(spark, sf), tb.attempts(spark, sf)]
    return upserts.upsert_challenges(current, commands, children, tb.NOW, made, stored=stored)


@query("upsert_challenges", "select id, name, points, visible, source_folder, touched from merged", UPSERTS)
def upsert_challenges(spark, sf):
    return upserted(spark, sf)[0].select("id", "name", "points", "visible", "source_folder", touched())


@query("upsert_challenge_outcomes", "select seq, outcome from judged", UPSERTS)
def upsert_challenge_outcomes(spark, sf):
    return upserted(spark, sf, stored=False)[2].select("seq", "outcome")


@query(
    "replace_links",
    """
    select challenge_id, url, type from links where challenge_id not in (select id from merged where touched)
    union all select id, web, 'web' from merged where touched
    union all select id, nc, 'nc' from merged where nc is not null
    """,
    UPSERTS,
)
def replace_links(spark, sf):
    """The links after the upserts."""
    merged, lists, _ = upserted(spark, sf)
    links = tb.links(spark, sf).withColumn("id", F.col("id").cast("string"))
    return upserts.replace_links(links, merged, lists).select("challenge_id", "url", "type")


# --- patches -----------------------------------------------------------------------------------------------------

LAST = """(select p.{f} from patches p where p.{key} = t.id and p.{f} is not null order by p.seq desc limit 1)"""
HIT = "exists (select 1 from patches p where p.{key} = t.id)"

USER_PATCHES = """
patches as (
  select o_orderkey seq, o_custkey user_id,
         case when o_orderstatus = 'P' then 'user-' || cast(o_orderkey as varchar) end name,
         case when o_orderstatus <> 'F' then o_orderpriority = '1-URGENT' end eligible,
         case when o_orderpriority = '5-LOW' then true end admin
  from orders)
"""


def user_patches(spark, sf):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return orders(spark, sf).select(
        "seq",
        F.col("o_custkey").alias("user_id"),
        F.when(status == "P", F.concat(F.lit("user-"), F.col("seq").cast("string"))).alias("name"),
        F.when(status != "F", priority == "1-URGENT").alias("eligible"),
        F.when(priority == "5-LOW", True).alias("admin"),
    )


last_user = partial(LAST.format, key="user_id")


@query(
    "patch_users",
    f"""
    select t.id, coalesce({last_user(f='name')}, t.name) name, coalesce({last_user(f='eligible')}, t.eligible) eligible,
           coalesce({last_user(f='admin')}, t.admin) admin, {HIT.format(key='user_id')} touched
    from users t
    """,
    USER_PATCHES,
)
def patch_users(spark, sf):
    out = patches.patch_users(stamped(tb.users(spark, sf)), user_patches(spark, sf), tb.NOW)
    return out.select("id", "name", "eligible", "admin", touched())


TEAM_PATCHES = """
patches as (
  select o_orderkey seq, o_custkey team_id,
         case when o_orderstatus = 'P' then 'team-' || cast(o_orderkey as varchar) end name,
         case when o_orderstatus = 'O' then 'was ' || o_orderpriority end description,
         case when o_orderpriority = '2-HIGH' then o_orderstatus = 'F' end eligible,
         o_orderpriority in ('1-URGENT', '5-LOW') has_affiliation,
         case when o_orderpriority = '1-URGENT' then o_orderstatus end affiliation
  from orders)
"""


def team_patches(spark, sf):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return orders(spark, sf).select(
        "seq",
        F.col("o_custkey").alias("team_id"),
        F.when(status == "P", F.concat(F.lit("team-"), F.col("seq").cast("string"))).alias("name"),
        F.when(status == "O", F.concat(F.lit("was "), priority)).alias("description"),
        F.when(priority == "2-HIGH", status == "F").alias("eligible"),
        priority.isin("1-URGENT", "5-LOW").alias("has_affiliation"),
        F.when(priority == "1-URGENT", status).alias("affiliation"),
    )


last_team = partial(LAST.format, key="team_id")


@query(
    "patch_teams",
    f"""
    select t.id, coalesce({last_team(f='name')}, t.name) name,
           coalesce({last_team(f='description')}, t.description) description,
           coalesce({last_team(f='eligible')}, t.eligible) eligible,
           case when exists (select 1 from patches p where p.team_id = t.id and p.has_affiliation)
             then (select p.affiliation from patches p where p.team_id = t.id and p.has_affiliation
                   order by p.seq desc limit 1)
             else t.affiliation end affiliation
    from teams t
    """,
    TEAM_PATCHES,
)
def patch_teams(spark, sf):
    out = patches.patch_teams(tb.teams(spark, sf), team_patches(spark, sf))
    return out.select("id", "name", "description", "eligible", "affiliation")


@query(
    "patch_team_outcomes",
    """
    select p.seq, p.team_id id, cast(case when t.id is null then 0 else 1 end as bigint) affected
    from patches p left join teams t on t.id = p.team_id
    """,
    TEAM_PATCHES,
)
def patch_team_outcomes(spark, sf):
    return patches.patch_outcomes(team_patches(spark, sf), tb.teams(spark, sf), "team_id")


CHALL_PATCHES = """
patches as (
  select o_orderkey seq, o_custkey challenge_id,
         case when o_orderstatus = 'P' then 'renamed-' || cast(o_orderkey as varchar) end name,
         case when o_orderpriority = '3-MEDIUM' then cast(floor(o_totalprice / 1000) as int) end points,
         case when o_orderstatus <> 'F' then o_orderpriority <> '5-LOW' end visible,
         case when o_orderpriority = '1-URGENT' then 'tag-' || o_orderstatus end tag,
         case when o_orderpriority = '2-HIGH' then 'http://p.example/' || cast(o_orderkey as varchar) end link
  from orders)
"""


def challenge_patches(spark, sf):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    seq = F.col("seq").cast("string")
    link = F.struct(F.lit("web").alias("type"), F.concat(F.lit("http://p.example/"), seq).alias("location"))
    missing = F.lit(None)
    return orders(spark, sf).select(
        "seq",
        F.col("o_custkey").alias("challenge_id"),
        F.when(status == "P", F.concat(F.lit("renamed-"), seq)).alias("name"),
        F.when(priority == "3-MEDIUM", F.floor(F.col("o_totalprice") / 1000).cast("int")).alias("points"),
        F.when(status != "F", priority != "5-LOW").alias("visible"),
        F.when(priority == "1-URGENT", F.array(F.concat(F.lit("tag-"), status))).alias("tags"),
        F.when(priority == "2-HIGH", F.array(link)).alias("links"),
        missing.cast("string").alias("description"),
        missing.cast("string").alias("source_folder"),
        *[missing.cast("array<string>").alias(c) for c in ("authors", "hints", "categories")],
    )


last_chall = partial(LAST.format, key="challenge_id")


@query(
    "patch_challenges",
    f"""
    select t.id, coalesce({last_chall(f='name')}, t.name) name, coalesce({last_chall(f='points')}, t.points) points,
           coalesce({last_chall(f='visible')}, t.visible) visible,
           coalesce({last_chall(f='tag')}, t.description) tags, {HIT.format(key='challenge_id')} touched
    from challenges t
    """,
    CHALL_PATCHES,
)
def patch_challenges(spark, sf):
    out = patches.patch_challenges(stamped(tb.challenges(spark, sf)), challenge_patches(spark, sf), tb.NOW)
    return out.select("id", "name", "points", "visible", F.array_join("tags", "|").alias("tags"), touched())


@query(
    "patch_challenge_links",
    f"""
    select challenge_id, url, type from links t0
    where not exists (select 1 from patches p where p.challenge_id = t0.challenge_id and p.link is not null)
    union all
    select t.id, {last_chall(f='link')}, 'web' from challenges t where {last_chall(f='link')} is not null
    """,
    CHALL_PATCHES,
)
def patch_challenge_links(spark, sf):
    lists = patches.patched_links(challenge_patches(spark, sf))
    links = tb.links(spark, sf).withColumn("id", F.col("id").cast("string"))
    return upserts.replace_links(links, tb.challenges(spark, sf), lists).select("challenge_id", "url", "type")


JOINS = """
commands as (
  select e.event_id seq, e.user_id,
         case when e.value < 5 then 'nobody' else upper(t.name) end team_name, e.value < 60 auth_ok, t.id named
  from events e join teams t on t.id = e.event_id % (select count(*) from supplier)
  where e.event_type = 'signup'),
judged as (
  select c.*, case when c.team_name = 'nobody' then 'name_does_not_exist' when not c.auth_ok then 'auth'
              when c.user_id not in (select id from users) then 'does_not_exist' else 'joined' end outcome
  from commands c)
"""


def joined(spark, sf):
    """Sign-up events join a team named in capitals."""
    n = tb.raw(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    t = tb.teams(spark, sf)
    named = t.select(F.col("id").alias("named"), F.upper("name").alias("upper_name"))
    commands = (
        tb.raw(spark, sf, "events")
        .where("event_type = 'signup'")
        .withColumn("named", F.col("event_id") % n)
        .join(named, "named")
        .select(
            F.col("event_id").alias("seq"),
            "user_id",
            F.when(F.col("value") < 5, "nobody").otherwise(F.col("upper_name")).alias("team_name"),
            (F.col("value") < 60).alias("auth_ok"),
        )
    )
    return patches.join_team(stamped(tb.users(spark, sf)), t, commands, tb.NOW)


@query(
    "join_team",
    """
    select u.id, coalesce((select j.named from judged j where j.user_id = u.id and j.outcome = 'joined'
                           order by j.seq desc limit 1), u.team_id) team_id,
           exists (select 1 from judged j where j.user_id = u.id and j.outcome = 'joined') touched
    from users u
    """,
    JOINS,
)
def join_team(spark, sf):
    return joined(spark, sf)[0].select("id", "team_id", touched())


@query("join_team_outcomes", "select seq, outcome from judged", JOINS)
def join_team_outcomes(spark, sf):
    return joined(spark, sf)[1].select("seq", "outcome")


@query(
    "promoted_users",
    """
    select u.id, u.admin or exists (
      select 1 from commands c join reach r on r.id = c.admin_id and r.since < c.seq
      where c.auth_ok and c.target_id = u.id) admin
    from users u
    """,
    access_plans.PROMOTIONS,
)
def promoted_users(spark, sf):
    judged = access_plans.promotions(spark, sf)
    targets = access_plans.promotion_commands(spark, sf).select("seq", "target_id")
    u = stamped(tb.users(spark, sf))
    return patches.promote(u, judged.join(targets, "seq"), tb.NOW).select("id", "admin")


@query(
    "refused_patches",
    """
    select 'users' "table", 'name' "key", n "value", count(*) n
    from (select lower(coalesce(case when id % 5 = 0 then 'SAME ' || cast(id % 10 as varchar) end, name)) n from users)
    group by n having count(*) > 1
    union all
    select 'challenges', 'source_folder', n, count(*)
    from (select case when id % 7 = 0 then 'chall/' || cast(id + 1 as varchar) else source_folder end n from challenges)
    group by n having count(*) > 1
    """,
)
def refused_patches(spark, sf):
    """Batches that rename to names that are taken: the clashes for which each whole batch is refused."""
    none = {c: F.lit(None).cast(t) for c, t in (("eligible", "boolean"), ("admin", "boolean"))}
    u = stamped(tb.users(spark, sf))
    again = F.concat(F.lit("SAME "), (F.col("id") % 10).cast("string"))
    renames = u.where("id % 5 = 0").select(F.col("id").alias("seq"), F.col("id").alias("user_id"), again.alias("name"))
    c = stamped(tb.challenges(spark, sf))
    moves = c.where("id % 7 = 0").select(
        F.col("id").alias("seq"), F.col("id").alias("challenge_id"),
        F.concat(F.lit("chall/"), (F.col("id") + 1).cast("string")).alias("source_folder"),
        *[F.lit(None).cast(c.schema[f].dataType).alias(f) for f in patches.CHALLENGE_FIELDS if f != "source_folder"],
    )
    users = patches.patch_users(u, renames.withColumns(none), tb.NOW, unique=False)
    challenges = patches.patch_challenges(c, moves, tb.NOW, unique=False)
    return quality.table_duplicates(users, "users").unionByName(quality.table_duplicates(challenges, "challenges"))


# --- creation ----------------------------------------------------------------------------------------------------

# One command per customer, in key order. Names repeat per nation and segment and some are those of stored teams;
# founders repeat, some do not exist.
TEAM_CREATION = """
commands as (
  select c_custkey seq, case when c_acctbal > 8000 then coalesce(upper(s_name), 'team of ' || cast(c_custkey as varchar))
           when c_acctbal between 600 and 900 then null
           else c_mktsegment || ' ' || cast(c_nationkey as varchar) || ' ' || cast(c_custkey % 4 as varchar) end name,
         cast(floor(abs(c_acctbal)) as bigint) % (select count(*) + 20 from customer) founder_id,
         c_acctbal > 500 auth_ok
  from customer left join supplier on s_suppkey = c_custkey),
known as (
  select c.*, lower(c.name) in (select lower(name) from teams) stored, u.id is not null present,
         u.team_id, row_number() over (order by c.seq) rn
  from commands c left join users u on u.id = c.founder_id),
steps as (
  select cast(0 as bigint) rn, cast(-1 as bigint) seq, '' outcome, cast([] as varchar[]) names,
         cast([] as bigint[]) founders
  union all
  select k.rn, k.seq, o.outcome,
         case when o.outcome = 'created' then list_append(s.names, lower(k.name)) else s.names end,
         case when o.outcome = 'created' then list_append(s.founders, k.founder_id) else s.founders end
  from steps s join known k on k.rn = s.rn + 1,
  lateral (select case when k.name is null then 'missing_name'
                       when k.stored or list_contains(s.names, lower(k.name)) then 'name_taken'
                       when not k.present then 'does_not_exist'
                       when k.team_id is not null or list_contains(s.founders, k.founder_id) then 'already_on_team'
                       when not k.auth_ok then 'auth' else 'created' end outcome) o)
"""


def created_teams(spark, sf):
    n = tb.raw(spark, sf, "customer").agg(F.count(F.lit(1)) + 20).scalar()
    s = tb.raw(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    rest = F.concat_ws(
        " ", "c_mktsegment", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 4).cast("string")
    )
    own = F.concat(F.lit("team of "), F.col("c_custkey").cast("string"))
    balance = F.col("c_acctbal")
    name = F.when(balance > 8000, F.coalesce(F.upper("s_name"), own)).when(~balance.between(600, 900), rest)
    commands = (
        tb.raw(spark, sf, "customer")
        .join(s, "c_custkey", "left")
        .select(
            F.col("c_custkey").alias("seq"),
            name.alias("name"),
            F.lit("").alias("description"),
            F.lit(True).alias("eligible"),
            F.lit(None).cast("string").alias("affiliation"),
            (F.floor(F.abs("c_acctbal")).cast("bigint") % n).alias("founder_id"),
            (F.col("c_acctbal") > 500).alias("auth_ok"),
        )
    )
    return creation.create_teams(
        tb.teams(spark, sf), stamped(tb.users(spark, sf)), commands, tb.NOW, -1 - F.col("seq")
    )


@query("create_team_outcomes", "select seq, outcome from steps where rn > 0", TEAM_CREATION)
def create_team_outcomes(spark, sf):
    return created_teams(spark, sf)[2].select("seq", "outcome")


@query(
    "create_teams",
    """
    select id, name from teams
    union all
    select -1 - s.seq, k.name from steps s join known k on k.seq = s.seq where s.outcome = 'created'
    """,
    TEAM_CREATION,
)
def create_teams(spark, sf):
    return created_teams(spark, sf)[0].select("id", "name")


@query(
    "create_team_members",
    """
    select u.id, coalesce((select -1 - s.seq from steps s join known k on k.seq = s.seq
                           where s.outcome = 'created' and k.founder_id = u.id), u.team_id) team_id
    from users u
    """,
    TEAM_CREATION,
)
def create_team_members(spark, sf):
    return created_teams(spark, sf)[1].select("id", "team_id")


USER_CREATION = """
commands as (
  select c_custkey seq,
         case when c_acctbal > 9000 then upper(c_name) when c_acctbal between 600 and 900 then null
              else c_mktsegment || cast(cast(floor(abs(c_acctbal)) as bigint) % 200 as varchar) end name,
         case when c_acctbal < 0 then lower(c_name) || '@EXAMPLE.com' when c_acctbal between 800 and 1100 then null
              else 'm' || cast(cast(floor(abs(c_acctbal)) as bigint) * 7 % 600 as varchar) || '@example.org' end email
  from customer),
known as (
  select c.*, lower(c.name) in (select lower(name) from users) name_stored,
         lower(c.email) in (select lower(email) from users) email_stored, row_number() over (order by c.seq) rn
  from commands c),
steps as (
  select cast(0 as bigint) rn, cast(-1 as bigint) seq, '' outcome, cast([] as varchar[]) names,
         cast([] as varchar[]) emails
  union all
  select k.rn, k.seq, o.outcome,
         case when o.outcome = 'created' then list_append(s.names, lower(k.name)) else s.names end,
         case when o.outcome = 'created' then list_append(s.emails, lower(k.email)) else s.emails end
  from steps s join known k on k.rn = s.rn + 1,
  lateral (select case when k.name is null then 'missing_name' when k.email is null then 'missing_email'
                       when k.name_stored or list_contains(s.names, lower(k.name)) then 'name_taken'
                       when k.email_stored or list_contains(s.emails, lower(k.email)) then 'email_taken'
                       else 'created' end outcome) o)
"""


def created_users(spark, sf):
    whole = F.floor(F.abs("c_acctbal")).cast("bigint")
    commands = tb.raw(spark, sf, "customer").select(
        F.col("c_custkey").alias("seq"),
        F.when(F.col("c_acctbal") > 9000, F.upper("c_name"))
        .when(~F.col("c_acctbal").between(600, 900), F.concat("c_mktsegment", (whole % 200).cast("string")))
        .alias("name"),
        F.when(F.col("c_acctbal") < 0, F.concat(F.lower("c_name"), F.lit("@EXAMPLE.com")))
        .when(~F.col("c_acctbal").between(800, 1100), F.concat(F.lit("m"), (whole * 7 % 600).cast("string"), F.lit("@example.org")))
        .alias("email"),
        F.lit(True).alias("eligible"),
        F.lit(False).alias("admin"),
        F.col("c_name").alias("sub"),
        F.col("c_mktsegment").alias("provider"),
    )
    return creation.create_users(
        tb.users(spark, sf), tb.credentials(spark, sf), commands, tb.NOW, -1 - F.col("seq")
    )


@query("create_user_outcomes", "select seq, outcome from steps where rn > 0", USER_CREATION)
def create_user_outcomes(spark, sf):
    return created_users(spark, sf)[2].select("seq", "outcome")


@query(
    "create_users",
    """
    select id, name, email from users
    union all
    select -1 - s.seq, k.name, k.email from steps s join known k on k.seq = s.seq where s.outcome = 'created'
    """,
    USER_CREATION,
)
def create_users(spark, sf):
    return created_users(spark, sf)[0].select("id", "name", "email")


@query(
    "create_user_credentials",
    """
    select user_id, provider_name, sub from credentials
    union all
    select -1 - s.seq, c.c_mktsegment, c.c_name from steps s join customer c on c.c_custkey = s.seq
    where s.outcome = 'created'
    """,
    USER_CREATION,
)
def create_user_credentials(spark, sf):
    return created_users(spark, sf)[1].select("user_id", "provider_name", "sub")


# --- credentials -------------------------------------------------------------------------------------------------

# Each sign-in asks for a new subject under its provider; high orders ask for the first subject again.
ROTATION = """
commands as (
  select s.id seq, s.user_id, s.provider,
         case when o.o_orderstatus = 'P' then s.sub || '+' else s.sub end old_sub,
         case when o.o_orderstatus = 'F' then s.sub || '+' else s.sub end new_sub,
         row_number() over (partition by s.user_id, s.provider order by s.id) rn
  from signins s join orders o on o.o_orderkey = s.id),
steps as (
  select user_id, provider_name provider, cast(0 as bigint) rn, cast(-1 as bigint) seq, sub, '' outcome
  from credentials
  union all
  select c.user_id, c.provider, c.rn, c.seq, case when c.old_sub = s.sub then c.new_sub else s.sub end,
         case when c.old_sub = s.sub then 'stored' else 'auth' end
  from steps s join commands c on c.user_id = s.user_id and c.provider = s.provider and c.rn = s.rn + 1)
"""


def rotated(spark, sf):
    status = tb.raw(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    longer = F.concat("sub", F.lit("+"))
    commands = (
        tb.signins(spark, sf)
        .join(status, "id")
        .select(
            F.col("id").alias("seq"),
            "user_id",
            F.col("provider").alias("old_provider"),
            F.when(F.col("o_orderstatus") == "P", longer).otherwise(F.col("sub")).alias("old_sub"),
            F.col("provider").alias("new_provider"),
            F.when(F.col("o_orderstatus") == "F", longer).otherwise(F.col("sub")).alias("new_sub"),
        )
    )
    stored = stamped(tb.credentials(spark, sf)).withColumns({"id": F.col("user_id"), "last_used": F.lit(None).cast("timestamp_ntz")})
    return credentials.update_credentials(stored, commands, tb.NOW, -1 - F.col("user_id"))


@query(
    "update_credentials",
    """
    select user_id id, user_id, provider provider_name, sub, cast(null as bigint) last_used,
           cast(1685577600 as bigint) inserted_at,
           exists (select 1 from steps b where b.user_id = s.user_id and b.provider = s.provider
                   and b.outcome = 'stored') touched
    from steps s where rn = (select max(rn) from steps b where b.user_id = s.user_id and b.provider = s.provider)
    """,
    ROTATION,
)
def update_credentials(spark, sf):
    """The whole table: every column is kept, rows stored anew are stamped."""
    return rotated(spark, sf)[0].select(
        "id", "user_id", "provider_name", "sub", epoch("last_used").alias("last_used"),
        epoch("inserted_at").alias("inserted_at"), touched(),
    )


@query(
    "update_credential_outcomes",
    "select c.seq, coalesce(s.outcome, 'auth') outcome from commands c left join steps s on s.seq = c.seq",
    ROTATION,
)
def update_credential_outcomes(spark, sf):
    return rotated(spark, sf)[1].select("seq", "outcome")


# --- stored scores -----------------------------------------------------------------------------------------------

SCORE = """
cast(coalesce((select sum(c.points) from {ledger} s join challenges c on c.id = s.challenge_id
               where s.{key} = t.id), 0) as bigint)
"""
COUNT = "(select count(s.attempt_id) from {ledger} s where s.challenge_id = t.id)"

STORED = """
early as (select * from successes where solved_at < timestamp '2024-01-15 00:00:00'),
fresh as (select * from successes where solved_at >= timestamp '2024-01-15 00:00:00')
"""


def _split(spark, sf):
    led = tb.stored_ledger(spark, sf)
    late = F.col("solved_at") >= F.lit(tb.START).cast("timestamp_ntz")
    return led, led.where(~late), led.where(late)


def _owners(df):
    return stamped(df).withColumns({"score": F.lit(0).cast("bigint"), "last_solve": stamp(OLD)})


@query(
    "refresh_scores",
    f"""
    select 'team' kind, t.id, {SCORE.format(ledger='successes', key='team_id')} score,
           t.id in (select team_id from fresh) touched from teams t
    union all
    select 'user', t.id, {SCORE.format(ledger='successes', key='user_id')}, t.id in (select user_id from fresh)
    from users t
    union all
    select 'challenge', t.id, {COUNT.format(ledger='successes')}, t.id in (select challenge_id from fresh)
    from challenges t
    """,
    STORED,
)
def refresh_scores(spark, sf):
    """Scores stored for the first half, refreshed for the successes of the second."""
    led, early, fresh = _split(spark, sf)
    c = stamped(tb.challenges(spark, sf).withColumn("solve_count", F.lit(0).cast("bigint")))
    out = []
    for kind, key, df in (("team", "team_id", tb.teams(spark, sf)), ("user", "user_id", tb.users(spark, sf))):
        stored = refresh.recompute_owners(_owners(df), early, c, key)
        done = refresh.refresh_owners(stored, led, c, fresh, key, tb.NOW)
        out.append(done.select(F.lit(kind).alias("kind"), "id", "score", touched()))
    stored = refresh.recompute_challenges(c, early)
    done = refresh.refresh_challenges(stored, led, fresh, tb.NOW)
    out.append(done.select(F.lit("challenge").alias("kind"), "id", F.col("solve_count").alias("score"), touched()))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "recompute_all",
    f"""
    select 'team' kind, t.id, {SCORE.format(ledger='successes', key='team_id')} score from teams t
    union all
    select 'user', t.id, {SCORE.format(ledger='successes', key='user_id')} from users t
    union all
    select 'challenge', t.id, {COUNT.format(ledger='successes')} from challenges t
    """,
)
def recompute_all(spark, sf):
    led = tb.stored_ledger(spark, sf)
    c = tb.challenges(spark, sf).withColumn("solve_count", F.lit(0).cast("bigint"))
    teams = refresh.recompute_owners(_owners(tb.teams(spark, sf)), led, c, "team_id")
    users = refresh.recompute_owners(_owners(tb.users(spark, sf)), led, c, "user_id")
    counts = refresh.recompute_challenges(c, led).withColumnRenamed("solve_count", "score")
    parts = [("team", teams), ("user", users), ("challenge", counts)]
    rows = [df.select(F.lit(kind).alias("kind"), "id", "score") for kind, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "repaired_last_solve",
    """
    select t.id, (select cast(epoch(max(s.solved_at)) as bigint) from successes s where s.team_id = t.id) last_solve
    from teams t
    """,
)
def repaired_last_solve(spark, sf):
    out = refresh.repair_last_solve(_owners(tb.teams(spark, sf)), tb.successes(spark, sf), "team_id")
    return out.select("id", epoch("last_solve").alias("last_solve"))


# --- clearing and cascades ---------------------------------------------------------------------------------------

CLEARED = """
gone as (select id challenge_id from challenges where not visible),
kept as (select * from successes where challenge_id not in (select challenge_id from gone))
"""


def cleared(spark, sf):
    """Clear the hidden challenges; the archive already holds their attempts of the admins."""
    a = tb.stored_attempts(spark, sf)
    admins = tb.users(spark, sf).where("admin").select(F.col("id").alias("user_id"))
    ids = tb.challenges(spark, sf).where("not visible").select(F.col("id").alias("challenge_id"))
    start = removal.Solves(a, ledger.first_correct(a), a.limit(0).withColumn("deleted_at", stamp(OLD)))
    first = a.join(ids, "challenge_id", "left_semi").join(admins, "user_id", "left_semi").select("id")
    before = removal.delete_solves(start, first, OLD)
    c = tb.challenges(spark, sf).withColumn("solve_count", F.lit(0).cast("bigint"))
    users, teams = _owners(tb.users(spark, sf)), _owners(tb.teams(spark, sf))
    return removal.clear_challenges(before, users, teams, c, ids, tb.NOW)


@query(
    "clear_challenges_attempts",
    "select id from attempts where challenge_id not in (select challenge_id from gone)",
    CLEARED,
)
def clear_challenges_attempts(spark, sf):
    return cleared(spark, sf).solves.attempts.select("id")


@query("clear_challenges_successes", "select attempt_id from kept", CLEARED)
def clear_challenges_successes(spark, sf):
    return cleared(spark, sf).solves.successes.select("attempt_id")


@query(
    "clear_challenges_archive",
    """
    select id, cast(case when user_id in (select id from users where admin) then 1685577600 else 1706745600 end as bigint)
           deleted_at
    from attempts where challenge_id in (select challenge_id from gone)
    """,
    CLEARED,
)
def clear_challenges_archive(spark, sf):
    """Archived attempts of the cleared challenges, with the time of each deletion."""
    out = cleared(spark, sf)
    stamps = out.solves.archive.select("id", epoch("deleted_at").alias("deleted_at"))
    return out.archived.join(stamps, "id")


@query(
    "clear_challenges_scores",
    f"""
    select 'team' kind, t.id, {SCORE.format(ledger='kept', key='team_id')} score from teams t
    union all
    select 'user', t.id, {SCORE.format(ledger='kept', key='user_id')} from users t
    union all
    select 'challenge', t.id, {COUNT.format(ledger='kept')} from challenges t
    """,
    CLEARED,
)
def clear_challenges_scores(spark, sf):
    out = cleared(spark, sf)
    counts = out.challenges.withColumnRenamed("solve_count", "score")
    parts = [("team", out.teams), ("user", out.users), ("challenge", counts)]
    rows = [df.select(F.lit(kind).alias("kind"), "id", "score") for kind, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "cascade_delete",
    """
    select 'teams' tbl, id from teams where eligible
    union all
    select 'users', id from left_users
    union all
    select 'solve_attempts', id from left_attempts
    union all
    select 'solve_successes', attempt_id from successes where attempt_id in (select id from left_attempts)
    union all
    select 'auth_oauth', user_id from credentials where user_id in (select id from left_users)
    """,
    """
    left_users as (select * from users where team_id is null or team_id in (select id from teams where eligible)),
    left_attempts as (select * from attempts where team_id in (select id from teams where eligible)
                      and user_id in (select id from left_users))
    """,
)
def cascade_delete(spark, sf):
    """Delete the ineligible teams; the rows that are left in every table."""
    a = tb.stored_attempts(spark, sf)
    tables = {
        "teams": tb.teams(spark, sf),
        "users": tb.users(spark, sf),
        "solve_attempts": a,
        "solve_successes": cut(ledger.first_correct(a)).withColumn("id", F.col("attempt_id")),
        "auth_oauth": tb.credentials(spark, sf).withColumn("id", F.col("user_id")),
    }
    doomed = tables["teams"].where("not eligible").select("id")
    left = removal.cascade_delete(tables, "teams", doomed)
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("tbl"), "id") for name, df in left.items()])
