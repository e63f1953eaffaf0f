"""Tables written and read back, ids, link lists, and the payloads and outcomes of requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvelake.functions import text
from solvelake.functions.common import epoch, fold, stable_id
from solvelake.operators import catalog, ledger, scores, upserts
from solvelake.plans.access import BATCH, batch
from solvelake.plans.registry import query
from solvelake.plans.text import BODIES, bodies
from solvelake.schemas import LINK_TYPES
from solvelake.session import work_path
from solvelake.sources import envelope, responses, tables
from solvelake.sources import testbed as tb


@query(
    "stored_tables",
    """
    select 'parquet' fmt, id, challenge_id, url, type from links union all
    select 'json', id, challenge_id, url, type from links
    """,
)
def stored_tables(spark, sf):
    """The links written in two formats, partitioned in one, and read back by their declared schema."""
    links = tb.links(spark, sf)
    one, two = work_path(spark, "links"), work_path(spark, "links")
    tables.write_table(links, one, by="type")
    tables.write_json(links, two)
    back = [("parquet", tables.read_table(spark, "challenge_links", one, id_type="bigint"))]
    back.append(("json", tables.read_table(spark, "challenge_links", two, "json", "bigint")))
    rows = [df.select(F.lit(fmt).alias("fmt"), "id", "challenge_id", "url", "type") for fmt, df in back]
    return rows[0].unionByName(rows[1])


@query(
    "made_ids",
    """
    select id, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-'
               || substr(m, 21, 12) made
    from (select id, md5('4:user|' || length(lower(name)) || ':' || lower(name)) m from users)
    """,
)
def made_ids(spark, sf):
    """The ids that creation gives when the caller names none."""
    return tb.users(spark, sf).select("id", stable_id("user", fold("name")).alias("made"))


def _catalog(spark, sf) -> DataFrame:
    c = tb.challenges(spark, sf)
    counts = scores.solve_counts(c, tb.successes(spark, sf)).withColumnRenamed("challenge_id", "id")
    return catalog.challenge_catalog(c.join(counts, "id"), tb.links(spark, sf))


def _joined(kind: str, source: str) -> str:
    return f"""coalesce((select array_to_string(list(l.url order by l.url), '|') from links l
               where l.challenge_id = c.id and l.type = '{kind}'), '') {source}_{kind}"""


@query(
    "link_shapes",
    f"""
    select c.id, {", ".join(_joined(t, "nested") for t in LINK_TYPES)},
           {", ".join(_joined(t, "listed") for t in LINK_TYPES)}
    from challenges c
    """,
)
def link_shapes(spark, sf):
    """Links through the nested form and back, and through one list and back."""
    flat = catalog.challenge_catalog(tb.challenges(spark, sf), tb.links(spark, sf))
    nested = catalog.flatten_links(catalog.nest_links(flat))
    nested = nested.select("id", *[F.array_join(f"links_{t}", "|").alias(f"nested_{t}") for t in LINK_TYPES])
    listed = flat.select("id", upserts.link_list(**{t: F.col(f"links_{t}") for t in LINK_TYPES}).alias("links"))
    listed = listed.select("id", *catalog.split_links(F.col("links")))
    listed = listed.select("id", *[F.array_join(f"links_{t}", "|").alias(f"listed_{t}") for t in LINK_TYPES])
    return nested.join(listed, "id")


def _list(sql: str) -> str:
    return f"""coalesce('[' || nullif(array_to_string({sql}, ','), '') || ']', '[]')"""


def _urls(kind: str) -> str:
    return _list(f"""(select list('"' || l.url || '"' order by l.url) from links l
                      where l.challenge_id = c.id and l.type = '{kind}')""")


@query(
    "payloads",
    f"""
    select 'chall' kind, c.id, '{{"ok":"success","data":{{"__type":"chall","data":{{"id":' || cast(c.id as varchar)
      || ',"name":"' || c.name || '","description":"' || c.description || '","points":' || cast(c.points as varchar)
      || ',"authors":["' || c.flag || '"],"hints":[],"categories":'
      || {_list("""list_transform(c.categories, lambda x: '"' || x || '"')""")}
      || ',"tags":["' || c.description || '"],"solve_count":'
      || cast((select count(s.attempt_id) from successes s where s.challenge_id = c.id) as varchar)
      || ',"visible":' || cast(c.visible as varchar) || ',"source_folder":"' || c.source_folder || '","links":{{'
      || {" || ',' || ".join(f"""'"{t}":' || {_urls(t)}""" for t in LINK_TYPES)} || '}}}}}}}}' result
    from challenges c
    union all
    select 'user', u.id, '{{"ok":"success","data":{{"__type":"user","data":{{"id":' || cast(u.id as varchar) || ',"email":"'
      || u.email || '","name":"' || u.name || '","team_id":' || coalesce(cast(u.team_id as varchar), 'null')
      || ',"score":0,"last_solve":null,"eligible":' || cast(u.eligible as varchar) || ',"admin":'
      || cast(u.admin as varchar) || '}}}}}}'
    from users u
    union all
    select 'solve', a.id, '{{"ok":"success","data":{{"__type":"solve","data":{{"id":' || cast(a.id as varchar)
      || ',"user_id":' || cast(a.user_id as varchar) || ',"team_id":' || cast(a.team_id as varchar) || ',"chall_id":'
      || cast(a.challenge_id as varchar) || ',"correct":' || cast(a.correct as varchar) || ',"counted":'
      || cast(a.id in (select attempt_id from successes) as varchar) || ',"time":'
      || cast(cast(epoch(a.inserted_at) as bigint) as varchar) || '}}}}}}'
    from attempts a
    union all
    select 'availability', t.id, '{{"ok":"success","data":{{"__type":"availability","data":false}}}}' from teams t
    """,
)
def payloads(spark, sf):
    """Challenges with nested links, users, solves and name checks as response payloads, one row each."""
    c = catalog.nest_links(_catalog(spark, sf))
    u = tb.users(spark, sf).withColumns({"score": F.lit(0), "last_solve": F.lit(None).cast("bigint")})
    a = tb.stored_attempts(spark, sf)
    solved = ledger.solves(a, ledger.first_correct(a))
    taken = catalog.name_available(tb.teams(spark, sf).select(F.col("name")), tb.teams(spark, sf))
    checked = tb.teams(spark, sf).select("id", "name").join(taken, "name")

    def rows(df: DataFrame, kind: str, result: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "id", result.alias("result"))

    return reduce(
        DataFrame.unionByName,
        [
            rows(c, "chall", responses.payload("chall", responses.CHALLENGE)),
            rows(u, "user", responses.payload("user", responses.USER)),
            rows(solved, "solve", responses.payload("solve", responses.solve())),
            rows(checked, "availability", responses.success("availability", F.col("available"))),
        ],
    )


@query(
    "history_payloads",
    """
    select s.attempt_id id, '{"ok":"success","data":{"__type":"team_score_history","data":{"team_id":'
      || cast(s.team_id as varchar) || ',"score":' || cast(c.points as varchar) || ',"time":"'
      || strftime(s.solved_at, '%Y-%m-%dT%H:%M:%S') || '"}}}' result
    from successes s join challenges c on c.id = s.challenge_id
    """,
)
def history_payloads(spark, sf):
    """Score entries as payload rows, with the points of each counted solve as the score."""
    entries = scores.with_points(tb.successes(spark, sf), tb.challenges(spark, sf)).select(
        "attempt_id", "team_id", F.col("points").alias("score"), F.col("solved_at").alias("time")
    )
    result = responses.payload("team_score_history", responses.score_entry())
    return entries.select(F.col("attempt_id").alias("id"), result.alias("result"))


@query(
    "deploy_payloads",
    """
    select seq id, '{"ok":"success","data":{"__type":"status","data":{"status":"' || status
      || '","status_time":{"secs":' || cast(cast(floor(status_time) as bigint) as varchar) || ',"nanos":0},"chall_name":"'
      || 'chall/' || cast(chall as varchar) || '","poll_id":' || cast(seq as varchar) || ',"err_msg":'
      || case when status = 'failure' then '"failed"' else 'null' end || '}}}' result
    from deploy_log
    """,
)
def deploy_payloads(spark, sf):
    log = tb.deploy_log(spark, sf).select(
        F.col("seq").alias("id"), "status", F.floor("status_time").cast("bigint").alias("secs"), F.lit(0).alias("nanos"),
        F.concat(F.lit("chall/"), F.col("chall").cast("string")).alias("chall_name"), F.col("seq").alias("poll_id"),
        F.when(F.col("status") == "failure", "failed").alias("err_msg"),
    )
    return log.select("id", responses.payload("status", responses.deploy_status()).alias("result"))


SYNCS = """
syncs as (
  select event_id id, value,
         case event_type when 'click' then 'user' when 'purchase' then 'team' when 'error' then 'chall'
           when 'signup' then 'all_users' else 'all' end kind,
         '{"__sync_type":"' || case event_type when 'click' then 'user' when 'purchase' then 'team' when 'error' then 'chall'
           when 'signup' then 'all_users' else 'all' end || '"'
           || case when event_type in ('click', 'purchase', 'error') then ',"id":' || cast(user_id as varchar) else '' end
           || '}' event
  from events)
"""


def _syncs(spark, sf) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(e == "click", "user").when(e == "purchase", "team").when(e == "error", "chall")
    kind = kind.when(e == "signup", "all_users").otherwise("all")
    return tb.raw(spark, sf, "events").select(F.col("event_id").alias("id"), "value", kind.alias("kind"), "user_id")


@query(
    "sync_payloads",
    """
    select id, case when value < 20 then '{"ok":"err","data":{"__type":"webhook_server_error","info":"down"}}'
                    when value < 40 then '{"ok":"err","data":{"__type":"failed_to_sync","info":' || event || '}}'
                    else '{"ok":"success","data":{"__type":"synced","details":' || event || '}}' end result
    from syncs
    """,
    SYNCS,
)
def sync_payloads(spark, sf):
    kind, id_, value = F.col("kind"), F.col("user_id"), F.col("value")
    bad = responses.sync_failure(value >= 20, kind, id_, F.lit("down"))
    return _syncs(spark, sf).select("id", F.when(value < 40, bad).otherwise(responses.synced(kind, id_)).alias("result"))


@query(
    "other_error_bodies",
    """
    select event_id id,
      cast(case when value < 30 then 500 when value < 60 then 500 when value < 90 then 500 else 502 end as int) deploy_status,
      case when value < 30 then 'Failed to forward request to the deploy server'
           when value < 60 then 'The deploy server responded with an invalid data shape.'
           when value < 90 then 'There was a database issue that prevented the deploy message from being sent.'
           else 'busy ' || event_type end deploy_body,
      '{"message":"failed to send discord message","code":' || cast(user_id as varchar) || ',"status_message":"'
        || event_type || '","body":"b' || cast(user_id as varchar) || '"}' notify_body,
      '{"message":"failed to sync","sync_type":{"type":"' || case when event_type = 'click' then 'user"' else 'solves"' end
        || case when event_type = 'click' then ',"id":' || cast(user_id as varchar) else '' end || '}}' sync_body,
      '{"message":"failed to forward the sync req","reason":"' || event_type || '"}' forward_body
    from events
    """,
)
def other_error_bodies(spark, sf):
    """Errors of deployments, notifications and syncs."""
    value, kind, user = F.col("value"), F.col("event_type"), F.col("user_id")
    error = F.when(value < 30, "BadSend").when(value < 60, "BadResponse").when(value < 90, "DbError").otherwise("DeployServer")
    sync = F.when(kind == "click", "user").otherwise("solves")
    body = F.concat(F.lit("b"), user.cast("string"))
    return tb.raw(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        text.deploy_error_status(error, F.lit(502)).cast("int").alias("deploy_status"),
        text.deploy_error_body(error, F.concat(F.lit("busy "), kind)).alias("deploy_body"),
        text.notify_error_body(user, kind, body).alias("notify_body"),
        text.sync_error_body(sync, user).alias("sync_body"),
        text.sync_forward_error_body(kind).alias("forward_body"),
    )


@query(
    "participant_alerts",
    """
    select event_id id, 'participants' channel, 'CTF Updates' username, 'Wave ' || cast(user_id as varchar) || '!' content
    from events where event_type = 'signup'
    """,
)
def participant_alerts(spark, sf):
    """Alerts to the participants, decoded from request bodies."""
    message = F.concat(F.lit("Wave "), F.col("user_id").cast("string"), F.lit("!"))
    inner = F.struct(F.lit("alert").alias("__participant_message_type"), F.struct(message.alias("message")).alias("metadata"))
    whole = F.struct(F.struct(F.lit("participant").alias("__type"), inner.alias("details")).alias("discord"))
    requests = tb.raw(spark, sf, "events").where("event_type = 'signup'").select(
        F.col("event_id").alias("request_id"), F.to_json(whole).alias("body")
    )
    accepted, _ = envelope.route(requests, "bigint")
    alerts = envelope.commands(accepted, "discord", "participant/alert", "bigint")
    return responses.alert_outbox(alerts, keep=["request_id"]).withColumnRenamed("request_id", "id")


@query(
    "limit_outcomes",
    """
    select request_id, cast(case when n > 100 then 413 else 200 end as int) code,
           case when n > 100 then '{"RequestTooBig":[' || cast(n as varchar) || ',100]}' end error
    from (select request_id, cast(json_extract_string(payload, '$.details.params.limit') as bigint) n
          from kinds where kind = 'team/get_top_history' and request_id not in (select request_id from refused))
    """,
    BODIES,
)
def limit_outcomes(spark, sf):
    """Requests for too many top teams are answered, not raised."""
    accepted, _ = envelope.route(bodies(spark, sf), "bigint")
    asked = envelope.commands(accepted, "sql", "team/get_top_history", "bigint")
    return responses.limit_outcomes(asked).select("request_id", "code", "error")


@query(
    "attempt_batch_log",
    """
    select a.id, a.correct, a.counted, cast(epoch(a.inserted_at) as bigint) updated_at, a.counted success
    from (select b.id, b.inserted_at, b.flag_guess = c.flag correct,
                 b.id in (select id from right_ones where rn = 1) counted
          from admitted b join challenges c on c.id = b.challenge_id) a
    """,
    BATCH,
)
def attempt_batch_log(spark, sf):
    """New rows of the log, and whether the ledger got a row with an id of its own for them."""
    out = batch(spark, sf)
    made = out.successes.select(F.col("attempt_id").alias("_id"), (F.col("id") == -F.col("attempt_id")).alias("success"))
    rows = out.attempts.join(made, F.col("id") == F.col("_id"), "left")
    return rows.select("id", "correct", "counted", epoch("updated_at").alias("updated_at"), F.coalesce("success", F.lit(False)).alias("success"))


@query(
    "attempt_batch_outcomes",
    """
    select b.id, case when b.team_id is null then 'not_on_team' when b.sub is null then 'bad_auth' else 'accepted' end outcome
    from booked b
    """,
    BATCH,
)
def attempt_batch_outcomes(spark, sf):
    return batch(spark, sf).judged.select("id", "outcome")


@query(
    "attempt_batch_scores",
    """
    select 'user' kind, u.id, cast(coalesce((select sum(c.points) from everyone w join challenges c on c.id = w.challenge_id
                                             where w.user_id = u.id), 0) as bigint) score
    from users u where u.id in (select user_id from right_ones where rn = 1)
    union all
    select 'challenge', c.id, (select count(*) from everyone w where w.challenge_id = c.id)
    from challenges c where c.id in (select challenge_id from right_ones where rn = 1)
    union all
    select 'blood', f.challenge_id, f.id from (
      select a.*, row_number() over (partition by a.challenge_id order by a.inserted_at, a.id) k
      from admitted a join challenges c on c.id = a.challenge_id and c.flag = a.flag_guess
      where a.challenge_id not in (select challenge_id from attempts b where b.correct
                                   and b.inserted_at < timestamp '2024-01-15 00:00:00')) f
    where f.k = 1
    """,
    BATCH + """,
everyone as (
  select user_id, challenge_id from old union all select user_id, challenge_id from right_ones where rn = 1)
""",
)
def attempt_batch_scores(spark, sf):
    """Touched users and challenges after the batch, and the first bloods within it."""
    out = batch(spark, sf)
    now = F.lit(tb.NOW).cast("timestamp_ntz")
    users = out.users.where(F.col("updated_at") == now).select(F.lit("user").alias("kind"), "id", F.col("score").cast("bigint").alias("score"))
    challs = out.challenges.where(F.col("updated_at") == now).select(
        F.lit("challenge").alias("kind"), "id", F.col("solve_count").cast("bigint").alias("score")
    )
    bloods = out.bloods.select(F.lit("blood").alias("kind"), F.col("challenge_id").alias("id"), F.col("attempt_id").alias("score"))
    return users.unionByName(challs).unionByName(bloods)
