"""Envelopes, responses, notifications and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvelake.functions import text
from solvelake.functions.common import epoch
from solvelake.operators import deploys
from solvelake.plans.leaderboard import scored_teams
from solvelake.plans.registry import query
from solvelake.sources import envelope, responses
from solvelake.sources import testbed as tb

# One envelope per event: clicks attempt a solve, purchases announce and ask for the top teams, errors alert the
# staff, sign-ups join a team and sync, views poll a deployment. Cheap ones are cut short, dear ones lack a parameter.
BODY = """
concat(
  case event_type
    when 'click' then concat('{"sql":{"__type":"solve","details":{"__query_name":"attempt","params":{"user_id":',
      cast(user_id as {s}), ',"team_id":7,"chall_id":', cast(length(props) as {s}),
      ',"flag_guess":"flag ', event_type, '","user_auth":{"__type":"oauth","params":{"sub":"s', cast(user_id as {s}),
      '","provider":"p","oauth_allow_token":"t"}}}}},"discord":null')
    when 'purchase' then concat('{"sql":{"__type":"team","details":{"__query_name":"get_top_history","params":{"limit":',
      cast(user_id as {s}), ',"start_time":"2024-01-15T00:00:00"}}},"discord":{"__type":"participant","details":',
      '{"__participant_message_type":"first_blood","metadata":{"chall_name":"c","team":"t"',
      case when value > 100 then '' else concat(',"user":"u', cast(user_id as {s}), '"') end, '}}}')
    when 'error' then concat('{"discord":{"__type":"developer","details":{"level":"',
      case when value < 20 then 'INFO' when value < 60 then 'WARN' when value < 120 then 'ERROR' else 'FATAL' end,
      '","message":"event ', cast(event_id as {s}), '","data":{"k":[1,2]},"include_chall_writers":',
      case when value < 40 then 'true' else 'false' end, '}}')
    when 'signup' then concat('{"frontend":{"__type":"sync","data":{"__sync_type":"',
      case when value < 50 then concat('user","id":', cast(user_id as {s})) else 'all_teams"' end,
      '}},"sql":{"__type":"user","details":{"__query_name":"join","params":{"id":', cast(user_id as {s}),
      ',"auth":{"__type":"pass","params":{"password":"x"}},"team_name":"Team ', cast(user_id as {s}),
      '","team_pass":"y"}}}')
    else concat('{"deploy":{"__type":"poll","data":{"id":',
      case when value > 150 then '"none"' else cast(event_id as {s}) end, '}}')
  end,
  case when value < 2 then '' else '}' end)
"""

BODIES = f"""
bodies as (select event_id request_id, event_type, user_id, value, props,
  {BODY.replace('{s}', 'varchar')} body from events),
parsed as (
  select *, case when json_valid(body) then cast(body as json) end j from bodies),
members as (
  select request_id, 'deploy' target, event_type, user_id, value, json_extract(j, '$.deploy') payload, j from parsed
  union all select request_id, 'discord', event_type, user_id, value, json_extract(j, '$.discord'), j from parsed
  union all select request_id, 'frontend', event_type, user_id, value, json_extract(j, '$.frontend'), j from parsed
  union all select request_id, 'sql', event_type, user_id, value, json_extract(j, '$.sql'), j from parsed),
present as (
  select *, json_extract_string(payload, '$.__type') tag from members
  where payload is not null and json_type(payload) <> 'NULL'),
kinds as (
  select request_id, target, payload, case
      when target = 'sql' then tag || '/' || json_extract_string(payload, '$.details.__query_name')
      when target = 'frontend' then tag || '/' || json_extract_string(payload, '$.data.__sync_type')
      when tag = 'participant' then tag || '/' || json_extract_string(payload, '$.details.__participant_message_type')
      else tag end kind,
    case when tag = 'developer'
           then json_extract_string(payload, '$.details.level') in ('INFO', 'WARN', 'ERROR')
         when tag = 'participant' then json_extract_string(payload, '$.details.metadata.user') is not null
         when tag = 'poll' then json_type(json_extract(payload, '$.data.id')) <> 'VARCHAR'
         else true end fine
  from present),
refused as (
  select request_id, 'malformed' reason from parsed where j is null
  union all
  select request_id, 'bad_' || min(target) from kinds where not fine group by request_id)
"""


def bodies(spark, sf):
    return tb.raw(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.expr(BODY.replace("{s}", "string")).alias("body")
    )


@query(
    "envelope_commands",
    "select request_id, target, kind from kinds where request_id not in (select request_id from refused)",
    BODIES,
)
def envelope_commands(spark, sf):
    return envelope.route(bodies(spark, sf), "bigint")[0].select("request_id", "target", "kind")


@query("envelope_refused", "select request_id, reason from refused", BODIES)
def envelope_refused(spark, sf):
    return envelope.route(bodies(spark, sf), "bigint")[1]


@query(
    "attempt_commands",
    """
    select request_id, cast(json_extract_string(payload, '$.details.params.user_id') as bigint) user_id,
           cast(json_extract_string(payload, '$.details.params.team_id') as bigint) team_id,
           cast(json_extract_string(payload, '$.details.params.chall_id') as bigint) chall_id,
           'oauth' user_auth_type, json_extract_string(payload, '$.details.params.user_auth.params.sub') user_auth_sub,
           json_extract_string(payload, '$.details.params.user_auth.params.provider') user_auth_provider,
           json_extract_string(payload, '$.details.params.flag_guess') flag_guess
    from kinds where kind = 'solve/attempt' and request_id not in (select request_id from refused)
    """,
    BODIES,
)
def attempt_commands(spark, sf):
    """Typed rows of the solve attempts among the envelopes."""
    accepted, _ = envelope.route(bodies(spark, sf), "bigint")
    return envelope.commands(accepted, "sql", "solve/attempt", "bigint")


@query(
    "history_commands",
    """
    select request_id, cast(json_extract_string(payload, '$.details.params.limit') as bigint) "limit",
           cast(json_extract_string(payload, '$.details.params.start_time') as timestamp) start_time
    from kinds where kind = 'team/get_top_history' and request_id not in (select request_id from refused)
    """,
    BODIES,
)
def history_commands(spark, sf):
    accepted, _ = envelope.route(bodies(spark, sf), "bigint")
    return envelope.commands(accepted, "sql", "team/get_top_history", "bigint")


RESULTS = """
results as (
  select event_id request_id, 'deploy' target,
         case when value < 10 then 502 when value < 30 then 404 else 200 end code from events
  union all
  select event_id, 'discord', case when value > 100 then 429 when value > 90 then 302 else 204 end
  from events where event_type <> 'view'
  union all
  select event_id, 'frontend', case when event_type = 'error' then 500 else 200 end
  from events where event_type in ('error', 'signup')
  union all
  select event_id, 'sql', case when event_type = 'click' and value < 60 then 403 when value < 20 then 413 else 200 end
  from events where event_type <> 'signup')
"""


def results(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    deploy = F.when(value < 10, 502).when(value < 30, 404).otherwise(200)
    discord = F.when(kind != "view", F.when(value > 100, 429).when(value > 90, 302).otherwise(204))
    frontend = F.when(kind == "error", 500).when(kind == "signup", 200)
    sql = F.when(kind != "signup", F.when((kind == "click") & (value < 60), 403).when(value < 20, 413).otherwise(200))
    codes = {"deploy": deploy, "discord": discord, "frontend": frontend, "sql": sql}
    rows = F.array(*[F.struct(F.lit(t).alias("target"), c.alias("code")) for t, c in codes.items()])
    e = tb.raw(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.inline(rows))
    return e.where("code is not null")


@query(
    "request_status_rollup",
    """
    select request_id, cast(case when count(*) filter (where code not between 200 and 299) = 0 then 200
      else coalesce(arg_min(code, target) filter (where code between 500 and 599),
                    arg_min(code, target) filter (where code between 400 and 499), 500) end as int) status
    from results group by request_id
    """,
    RESULTS,
)
def request_status_rollup(spark, sf):
    return responses.request_status(results(spark, sf))


@query(
    "assembled_responses",
    """
    select request_id, '{"deploy":' || coalesce(max(r) filter (where target = 'deploy'), 'null')
      || ',"discord":' || coalesce(max(r) filter (where target = 'discord'), 'null')
      || ',"frontend":' || coalesce(max(r) filter (where target = 'frontend'), 'null')
      || ',"sql":' || coalesce(max(r) filter (where target = 'sql'), 'null') || '}' response
    from (select *, case when code between 200 and 299 then '{"ok":"success","data":{"__type":"' || target
                    || '","data":' || cast(code as varchar) || '}}' else '{"ok":"err","data":' || cast(code as varchar)
                    || '}' end r from results)
    group by request_id
    """,
    RESULTS,
)
def assembled_responses(spark, sf):
    """One response object per request; the codes stand in for the data."""
    good = F.lit(None).cast("string")
    for t in envelope.TARGETS:
        good = F.when(F.col("target") == t, responses.success(t, F.col("code"))).otherwise(good)
    bad = responses.failure(F.col("code").cast("string"))
    r = results(spark, sf).withColumn("result", F.when(F.col("code").between(200, 299), good).otherwise(bad))
    return responses.assemble(r).select("request_id", "response")


@query(
    "result_json",
    """
    select id, '{"ok":"success","data":{"__type":"team","data":{"id":' || cast(id as varchar) || ',"name":"' || name
      || '","score":' || cast(score as varchar) || ',"last_solve":'
      || coalesce(cast(cast(epoch(last_solve) as bigint) as varchar), 'null') || ',"eligible":'
      || cast(eligible as varchar) || ',"affiliation":"' || affiliation || '"}}}' result
    from scored_teams
    """,
)
def result_json(spark, sf):
    """Every team as a response payload."""
    t = scored_teams(spark, sf).withColumn("last_solve", epoch("last_solve"))
    data = F.struct("id", "name", "score", "last_solve", "eligible", "affiliation")
    return t.select("id", responses.success("team", data).alias("result"))


ERRORS = """
errors as (
  select event_id id, value,
         case when value > 150 then 'RequestTooBig' when value > 100 then 'OtherServerError'
           when event_type = 'click' then 'DatabaseError' when event_type = 'view' then 'Auth'
           when event_type = 'error' then 'DoesNotExist' when event_type = 'signup' then 'NameDoesNotExist'
           else 'NameIsTaken' end kind,
         'n' || cast(user_id as varchar) "name", 'why ' || event_type info, user_id size
  from events)
"""


def errors(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    name = (
        F.when(value > 150, "RequestTooBig")
        .when(value > 100, "OtherServerError")
        .when(kind == "click", "DatabaseError")
        .when(kind == "view", "Auth")
        .when(kind == "error", "DoesNotExist")
        .when(kind == "signup", "NameDoesNotExist")
        .otherwise("NameIsTaken")
    )
    return tb.raw(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        name.alias("kind"),
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("name"),
        F.concat(F.lit("why "), kind).alias("info"),
        F.col("user_id").alias("size"),
    )


# The texts in this SQL and below are the fixed values of functions/text.py.
@query(
    "error_bodies",
    """
    select id,
      cast(case kind when 'RequestTooBig' then 413 when 'DoesNotExist' then 404 when 'NameDoesNotExist' then 404
        when 'Auth' then 403 when 'NameIsTaken' then 400 else 500 end as int) status,
      case kind
        when 'OtherServerError' then '{"err":"An unknown server error occured.","info":"' || info || '"}'
        when 'DatabaseError' then '{"err":"Unexpected database error encountered."}'
        when 'Auth' then '{"err":"Unauthorized access."}'
        when 'DoesNotExist' then '{"err":"This id does not exist.","id":' || cast(id as varchar) || '}'
        when 'NameDoesNotExist' then '{"err":"This name does not exist.","name":"' || "name" || '"}'
        when 'NameIsTaken' then '{"err":"A team with this name already exists.","name":"' || "name" || '"}'
        else '{"err":"Request too big (Check that your request is in size limits).","size":' || cast(size as varchar)
             || ',"limit":100}' end body,
      case kind when 'OtherServerError' then '{"OtherServerError":"' || info || '"}'
        when 'DoesNotExist' then '{"DoesNotExist":' || cast(id as varchar) || '}'
        when 'NameDoesNotExist' then '{"NameDoesNotExist":"' || "name" || '"}'
        when 'NameIsTaken' then '{"NameIsTaken":"' || "name" || '"}'
        when 'RequestTooBig' then '{"RequestTooBig":[' || cast(size as varchar) || ',100]}'
        else '"' || kind || '"' end data
    from errors
    """,
    ERRORS,
)
def error_bodies(spark, sf):
    kind = F.col("kind")
    detail = [F.col("info"), F.col("id"), F.col("name"), F.col("size"), F.lit(100)]
    return errors(spark, sf).select(
        "id",
        text.table_error_status(kind).alias("status"),
        text.table_error_body(kind, *detail).alias("body"),
        text.table_error_data(kind, *detail).alias("data"),
    )


@query(
    "staff_alerts",
    """
    select case when value < 40 then 'chall_writers' else 'admins' end channel, 'Alerts' username,
           '-------------------' || chr(10) || '# Urgency: '
           || case when value < 20 then 'Info ' when value < 60 then 'Warn ' else 'Error' end || chr(10)
           || case when value < 40 then '<@&11> ' else '' end || '<@&22> ' || chr(10)
           || 'event ' || cast(event_id as varchar) || ' of user ' || cast(user_id as varchar) content
    from events where event_type = 'error'
    """,
)
def staff_alerts(spark, sf):
    value = F.col("value")
    alerts = tb.raw(spark, sf, "events").where("event_type = 'error'").select(
        F.when(value < 20, "INFO").when(value < 60, "WARN").otherwise("ERROR").alias("level"),
        F.concat(
            F.lit("event "), F.col("event_id").cast("string"), F.lit(" of user "), F.col("user_id").cast("string")
        ).alias("message"),
        (value < 40).alias("include_chall_writers"),
    )
    return responses.staff_outbox(alerts, "11", "22")


@query(
    "sync_events",
    """
    select event_id, case event_type
        when 'click' then '{"__type":"solves"}' when 'view' then '{"__type":"all_teams"}'
        when 'signup' then '{"__type":"user","id":' || cast(user_id as varchar) || '}'
        when 'purchase' then '{"__type":"chall","id":' || json_extract_string(props, '$.k') || '}'
        else '{"__type":"all"}' end event,
      '{"message":"failed to sync","sync_type":' || case event_type
        when 'click' then '{"type":"solves"}' when 'view' then '{"type":"all_teams"}'
        when 'signup' then '{"type":"user","id":' || cast(user_id as varchar) || '}'
        when 'purchase' then '{"type":"chall","id":' || json_extract_string(props, '$.k') || '}'
        else '{"type":"all"}' end || '}' error
    from events
    """,
)
def sync_events(spark, sf):
    kind = F.col("event_type")
    tag = (
        F.when(kind == "click", "solves").when(kind == "view", "all_teams").when(kind == "signup", "user")
        .when(kind == "purchase", "chall").otherwise("all")
    )
    k = F.get_json_object("props", "$.k").cast("bigint")
    id_ = F.when(kind == "signup", F.col("user_id")).otherwise(k)
    return tb.raw(spark, sf, "events").select(
        "event_id", text.sync_event(tag, id_).alias("event"), text.sync_error_body(tag, id_).alias("error")
    )


@query(
    "display_truncated",
    """
    select kind, id, case when length(name) >= 13 then substr(name, 1, 10) || '...' else name end display
    from (select 'team' kind, id, name from teams union all select 'user', id, name from users
          union all select 'challenge', id, name from challenges)
    """,
)
def display_truncated(spark, sf):
    """Entity names as shown in logs."""
    parts = [("team", tb.teams(spark, sf)), ("user", tb.users(spark, sf)), ("challenge", tb.challenges(spark, sf))]
    rows = [df.select(F.lit(k).alias("kind"), "id", text.shortened("name", 13).alias("display")) for k, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "escaped_texts",
    """
    select doc_id, md5(replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), chr(0), '\\0'),
      chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r'), '''', '\\'''), '"', '\\"')) digest
    from documents
    """,
)
def escaped_texts(spark, sf):
    """Whole documents with quotes and control characters escaped."""
    return tb.raw(spark, sf, "documents").select("doc_id", F.md5(text.escaped("text")).alias("digest"))


DEPLOYS = """
requests as (
  select event_id request_id, event_type = 'error' force_wipe,
         case when value < 30 then md5(cast(user_id as varchar)) end digest,
         'chall/' || cast(event_id as varchar) folder
  from events),
spelled as (
  select *, substr(digest, 1, 8) || '-' || substr(digest, 9, 4) || '-' || substr(digest, 13, 4) || '-'
            || substr(digest, 17, 4) || '-' || substr(digest, 21, 12) uuid
  from requests),
named as (
  select *, case when digest is null then folder
                 else case request_id % 4 when 0 then uuid when 1 then upper(uuid) when 2 then digest
                      else 'urn:uuid:' || uuid end end chall
  from spelled)
"""


@query(
    "deploy_ids",
    """
    select r.request_id, r.chall,
           case when r.force_wipe then 'new-' || cast(r.request_id as varchar)
                when r.digest is not null then r.uuid
                else coalesce((select cast(c.id as varchar) from challenges c where c.source_folder = r.chall),
                              'new-' || cast(r.request_id as varchar)) end deploy_id
    from named r
    """,
    DEPLOYS,
)
def deploy_ids(spark, sf):
    d = F.md5(F.col("user_id").cast("string"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    uuid = F.concat_ws("-", *[F.substring(d, a, n) for a, n in cuts])
    spellings = F.array(uuid, F.upper(uuid), d, F.concat(F.lit("urn:uuid:"), uuid))
    folder = F.concat(F.lit("chall/"), F.col("event_id").cast("string"))
    asked = tb.raw(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("value") < 30, F.get(spellings, (F.col("event_id") % 4).cast("int"))).otherwise(folder).alias("chall"),
        (F.col("event_type") == "error").alias("force_wipe"),
    )
    new_id = F.concat(F.lit("new-"), F.col("request_id").cast("string"))
    return deploys.deploy_ids(asked, tb.challenges(spark, sf), new_id).select("request_id", "chall", "deploy_id")


@query(
    "latest_deploy_status",
    """
    select chall, status, status_time from deploy_log d
    where (ts, seq) = (select (b.ts, b.seq) from deploy_log b where b.chall = d.chall
                       order by b.ts desc, b.seq desc limit 1)
    """,
)
def latest_deploy_status(spark, sf):
    return deploys.latest_statuses(tb.deploy_log(spark, sf)).select("chall", "status", "status_time")


@query(
    "deploy_status_lines",
    """
    select seq, lpad(status, cast(greatest(9, length(status)) as int), ' ') || ' for '
      || printf('%.1f', age + case when age * 4 = floor(age * 4) and floor(age * 4) % 2 = 1 then 0.01 else 0 end)
      || ' seconds' line
    from (select seq, status, floor(status_time) + round((status_time - floor(status_time)) * 1e9) * 1e-9 age
          from deploy_log)
    """,
)
def deploy_status_lines(spark, sf):
    """Every status report as the line an operator would see."""
    secs = F.floor("status_time")
    nanos = F.round((F.col("status_time") - secs) * F.lit(1e9)).cast("int")
    return tb.deploy_log(spark, sf).select("seq", text.status_line(F.col("status"), secs, nanos).alias("line"))


@query(
    "split_names",
    """
    select doc_id, unnest(string_split(names, ',')) "name"
    from (select p_partkey doc_id, replace(p_name, ' ', ',') names from part)
    """,
)
def split_names(spark, sf):
    """Comma lists of names, one row per name."""
    return tb.raw(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"), text.split_names(F.replace("p_name", F.lit(" "), F.lit(","))).alias("name")
    )
