"""Rendering of names, notifications, statuses and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from solvelake.functions.common import _c

# Message texts, sender names, urgency labels.
RULE = "-------------------"
URGENCY = {"INFO": "Info ", "WARN": "Warn ", "ERROR": "Error"}
ALERT_SENDER = "Alerts"
UPDATE_SENDER = "CTF Updates"

# Escapes of control characters with a short form.
SHORT_ESCAPES = [("\\", "\\\\"), ("\0", "\\0"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("'", "\\'"), ('"', '\\"')]


def escaped(col: Column | str) -> Column:
    """Escape quotes, backslashes and ASCII control characters."""
    out = _c(col)
    for char, text in SHORT_ESCAPES:
        out = F.replace(out, F.lit(char), F.lit(text))
    done = {char for char, _ in SHORT_ESCAPES}
    for code in [*range(1, 32), 127]:
        if chr(code) not in done:
            out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{{{code:x}}}"))
    return out


def shortened(col: Column | str, max_len: int) -> Column:
    """Escaped text; texts of ``max_len`` characters or more keep ``max_len - 3`` of them and end in dots."""
    if max_len < 3:
        raise ValueError("max_len must be at least 3")
    text = _c(col)
    cut = F.concat(escaped(F.substring(text, 1, max_len - 3)), F.lit("..."))
    return F.when(F.char_length(text) >= max_len, cut).otherwise(escaped(text))


def first_blood_message(chall: Column | str, team: Column | str, user: Column | str) -> Column:
    """Announcement of a first solver; backticks in the user and team names become apostrophes."""
    plain_user, plain_team = (F.translate(_c(c), "`", "'") for c in (user, team))
    # The words of the announcement.
    return F.concat(
        F.lit("First :drop_of_blood: by `"), plain_user, F.lit("` from `"), plain_team,
        F.lit("` on challenge `"), _c(chall), F.lit("`!"),
    )


def staff_alert(level: Column, message: Column, to_writers: Column, writer_role: str, admin_role: str) -> Column:
    """Staff alert: rule, urgency, role mentions, body."""
    label = F.lit(None).cast("string")
    for name, text in URGENCY.items():
        label = F.when(level == name, text).otherwise(label)
    admins = F.lit(f"<@&{admin_role}> ")
    mentions = F.when(to_writers, F.concat(F.lit(f"<@&{writer_role}> "), admins)).otherwise(admins)
    # Fixed value: the heading of the urgency.
    return F.concat_ws("\n", F.lit(RULE), F.concat(F.lit("# Urgency: "), label), mentions, message)


def sync_event(kind: Column, id_: Column, tag: str = "__type") -> Column:
    """Cache-sync event as JSON; kinds without an id carry none. Failed syncs are reported under the tag ``type``."""
    return F.to_json(F.struct(kind.alias(tag), F.when(kind.isin("chall", "team", "user"), id_).alias("id")))


def one_decimal(x: Column) -> Column:
    """A non-negative double to one decimal, exact: half-way cases go up, others to the nearer tenth.

    The fraction times 2^57 is a whole number, so the choice is made in integers; printf in the JVM would round the
    shortest decimal form of the double instead.
    """
    whole = F.floor(x).cast("bigint")
    fraction = ((x - whole) * F.lit(float(2**57))).cast("bigint")
    tenths = whole * 10 + F.shiftright(fraction * 10 + F.lit(2**56), 57)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def status_line(status: Column | str, secs: Column | str, nanos: Column | str) -> Column:
    """Deployment status, padded to nine characters, with its age to one decimal."""
    name = _c(status)
    padded = F.when(F.char_length(name) < 9, F.lpad(name, 9, " ")).otherwise(name)
    age = _c(secs).cast("double") + _c(nanos).cast("double") * F.lit(1e-9)
    return F.concat(padded, F.lit(" for "), one_decimal(age), F.lit(" seconds"))


def split_names(names: Column | str) -> Column:
    """A comma-separated list of challenge names, one row each."""
    return F.explode(F.split(_c(names), ","))


# Error kinds of table requests with their status and message.
TABLE_ERRORS = {
    "OtherServerError": (500, "An unknown server error occured."),
    "DatabaseError": (500, "Unexpected database error encountered."),
    "Auth": (403, "Unauthorized access."),
    "DoesNotExist": (404, "This id does not exist."),
    "NameDoesNotExist": (404, "This name does not exist."),
    "NameIsTaken": (400, "A team with this name already exists."),
    "RequestTooBig": (413, "Request too big (Check that your request is in size limits)."),
}

# Deploy error texts.
DEPLOY_ERRORS = {
    "BadSend": "Failed to forward request to the deploy server",
    "BadResponse": "The deploy server responded with an invalid data shape.",
    "DbError": "There was a database issue that prevented the deploy message from being sent.",
}


def _pick(key: Column, values: dict) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


def table_error_status(kind: Column) -> Column:
    return _pick(kind, {k: code for k, (code, _) in TABLE_ERRORS.items()})


def table_error_body(kind: Column, info: Column, id_: Column, name: Column, size: Column, limit: Column) -> Column:
    """JSON error body; each kind shows only its own detail."""
    return F.to_json(
        F.struct(
            _pick(kind, {k: text for k, (_, text) in TABLE_ERRORS.items()}).alias("err"),
            F.when(kind == "OtherServerError", info).alias("info"),
            F.when(kind == "DoesNotExist", id_).alias("id"),
            F.when(kind.isin("NameDoesNotExist", "NameIsTaken"), name).alias("name"),
            F.when(kind == "RequestTooBig", size).alias("size"),
            F.when(kind == "RequestTooBig", limit).alias("limit"),
        )
    )


def table_error_data(kind: Column, info: Column, id_: Column, name: Column, size: Column, limit: Column) -> Column:
    """The error as response data: the bare kind, or the kind with its detail."""
    detail = (
        F.when(kind == "OtherServerError", F.to_json(F.struct(info.alias("OtherServerError"))))
        .when(kind == "DoesNotExist", F.to_json(F.struct(id_.alias("DoesNotExist"))))
        .when(kind == "NameDoesNotExist", F.to_json(F.struct(name.alias("NameDoesNotExist"))))
        .when(kind == "NameIsTaken", F.to_json(F.struct(name.alias("NameIsTaken"))))
        .when(kind == "RequestTooBig", F.to_json(F.struct(F.array(size, limit).alias("RequestTooBig"))))
    )
    return F.coalesce(detail, F.concat(F.lit('"'), kind, F.lit('"')))


def deploy_error_status(kind: Column, code: Column) -> Column:
    return F.when(kind == "DeployServer", code).when(kind.isin(*DEPLOY_ERRORS), 500)


def deploy_error_body(kind: Column, body: Column) -> Column:
    """Text of a deploy error; the deploy server's own errors pass their body through."""
    return F.when(kind == "DeployServer", body).otherwise(_pick(kind, DEPLOY_ERRORS))


def notify_error_body(code: Column, status_message: Column, body: Column) -> Column:
    # Fixed value: the message, as in the two bodies below.
    return F.to_json(
        F.struct(
            F.lit("failed to send discord message").alias("message"),
            code.alias("code"),
            status_message.alias("status_message"),
            body.alias("body"),
        )
    )


def sync_error_body(kind: Column, id_: Column) -> Column:
    tag = F.struct(kind.alias("type"), F.when(kind.isin("chall", "team", "user"), id_).alias("id"))
    return F.to_json(F.struct(F.lit("failed to sync").alias("message"), tag.alias("sync_type")))


def sync_forward_error_body(reason: Column) -> Column:
    return F.to_json(F.struct(F.lit("failed to forward the sync req").alias("message"), reason.alias("reason")))
