"""Response bodies, per-request status, and the outbox of notifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvelake.functions import text
from solvelake.functions.common import epoch
from solvelake.operators.leaderboard import MAX_TEAMS
from solvelake.sources.envelope import TARGETS

KEEP_NULLS = {"ignoreNullFields": "false"}


def success(kind: str, data: Column) -> Column:
    """``{"ok":"success","data":{"__type":kind,"data":...}}``"""
    tagged = F.struct(F.lit(kind).alias("__type"), data.alias("data"))
    return F.to_json(F.struct(F.lit("success").alias("ok"), tagged.alias("data")), KEEP_NULLS)


def payload(kind: str, fields: Sequence[Column | str]) -> Column:
    """One entity as a successful result; lists are rows of such results, never one cell."""
    return success(kind, F.struct(*fields))


# The fields of each payload.
CHALLENGE = [
    "id", "name", "description", "points", "authors", "hints", "categories", "tags", "solve_count", "visible",
    "source_folder", "links",
]
TEAM = ["id", "name", "score", "last_solve", "eligible", "affiliation"]
USER = ["id", "email", "name", "team_id", "score", "last_solve", "eligible", "admin"]


def solve() -> list[Column]:
    """Fields of a solve, with its time in seconds since the epoch."""
    return [
        F.col("id"), F.col("user_id"), F.col("team_id"), F.col("challenge_id").alias("chall_id"), F.col("correct"),
        F.col("counted"), epoch("inserted_at").alias("time"),
    ]


def score_entry() -> list[Column]:
    """Fields of an entry of a score history, with its time as a naive timestamp."""
    return [F.col("team_id"), F.col("score"), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss").alias("time")]


def deploy_status() -> list[Column]:
    """Fields of a deployment status; the age is in whole seconds and nanoseconds."""
    age = F.struct(F.col("secs"), F.col("nanos"))
    return [F.col("status"), age.alias("status_time"), F.col("chall_name"), F.col("poll_id"), F.col("err_msg")]


def synced(kind: Column, id_: Column) -> Column:
    """The frontend's answer to a sync: the event that was forwarded."""
    details = F.concat(F.lit('{"__type":"synced","details":'), text.sync_event(kind, id_, "__sync_type"), F.lit("}"))
    return F.concat(F.lit('{"ok":"success","data":'), details, F.lit("}"))


def sync_failure(forwarded: Column, kind: Column, id_: Column, reason: Column) -> Column:
    """The frontend's error as tagged data: the event that failed, or why it could not be forwarded."""
    lost = F.concat(F.lit('{"__type":"failed_to_sync","info":'), text.sync_event(kind, id_, "__sync_type"), F.lit("}"))
    down = F.to_json(F.struct(F.lit("webhook_server_error").alias("__type"), reason.alias("info")))
    return failure(F.when(forwarded, lost).otherwise(down))


def limit_outcomes(requests: DataFrame, limit: str = "limit", most: int = MAX_TEAMS) -> DataFrame:
    """Requests with ``code`` (200, or 413 above ``most`` teams) and ``error``, the error's data or null."""
    big = F.col(limit) > most
    error = F.when(
        big, text.table_error_data(F.lit("RequestTooBig"), F.lit(None), F.lit(None), F.lit(None), F.col(limit), F.lit(most))
    )
    return requests.withColumns({"code": F.when(big, 413).otherwise(200), "error": error})


def failure(data: Column) -> Column:
    """``{"ok":"err","data":...}`` around an error that is JSON already."""
    return F.concat(F.lit('{"ok":"err","data":'), data, F.lit("}"))


def assemble(results: DataFrame) -> DataFrame:
    """Results (request_id, target, code, result) to one row per request: ``status`` and ``response``.

    Targets without a result show as null.
    """
    member = {t: F.max(F.when(F.col("target") == t, F.col("result"))) for t in TARGETS}
    body = [F.concat(F.lit(f'"{t}":'), F.coalesce(c, F.lit("null"))) for t, c in member.items()]
    response = F.concat(F.lit("{"), F.concat_ws(",", *body), F.lit("}"))
    return results.groupBy("request_id").agg(_status().alias("status"), response.alias("response"))


def _status() -> Column:
    """200 if every code is 2xx; else the first 5xx, else the first 4xx, else 500, in target order."""
    code = F.col("code")
    pos = F.array_position(F.array(*[F.lit(t) for t in TARGETS]), F.col("target"))

    def first(low: int) -> Column:
        return F.min_by(code, F.when(code.between(low, low + 99), pos))

    bad = F.count_if(~code.between(200, 299))
    return F.when(bad == 0, 200).otherwise(F.coalesce(first(500), first(400), F.lit(500))).cast("int")


def request_status(results: DataFrame) -> DataFrame:
    """(request_id, target, code) rows to (request_id, status)."""
    return results.groupBy("request_id").agg(_status().alias("status"))


def outbox(
    messages: DataFrame, channel: Column, username: Column, content: Column, keep: Sequence[str] = ()
) -> DataFrame:
    """Message rows (channel, username, content) for a delivery service to pick up, with the columns ``keep``."""
    return messages.select(*keep, channel.alias("channel"), username.alias("username"), content.alias("content"))


def first_blood_outbox(
    details: DataFrame, sender: str = text.UPDATE_SENDER, keep: Sequence[str] = ()
) -> DataFrame:
    content = text.first_blood_message("chall", "team", "user")
    return outbox(details, F.lit("participants"), F.lit(sender), content, keep)


def staff_outbox(
    alerts: DataFrame, writer_role: str, admin_role: str, sender: str = text.ALERT_SENDER
) -> DataFrame:
    """Alerts (level, message, include_chall_writers), routed to the writers' or the admins' channel."""
    writers = F.col("include_chall_writers")
    content = text.staff_alert(F.col("level"), F.col("message"), writers, writer_role, admin_role)
    return outbox(alerts, F.when(writers, "chall_writers").otherwise("admins"), F.lit(sender), content)


def alert_outbox(alerts: DataFrame, sender: str = text.UPDATE_SENDER, keep: Sequence[str] = ()) -> DataFrame:
    """Alerts (message) to the participants, as they are."""
    return outbox(alerts, F.lit("participants"), F.lit(sender), F.col("message"), keep)


def sync_outbox(events: DataFrame) -> DataFrame:
    """Cache-sync events (kind, id) for the frontend."""
    return outbox(events, F.lit("frontend"), F.lit(None).cast("string"), text.sync_event(F.col("kind"), F.col("id")))
