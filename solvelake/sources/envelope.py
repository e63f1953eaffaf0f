"""JSON request envelopes: fan-out, validation, quarantine and typed commands.

An envelope is one JSON object with the optional members deploy, discord, frontend and sql. Every member is a tagged
union. One parse gives the tags as columns and the parameters as a variant, read with failure-tolerant paths.
A request is judged within its own row, so nothing is shuffled.
"""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvelake.functions.common import UUID, uuid_of
from solvelake.schemas import ALERT_LEVELS, LINK_TYPES

# Member names in response order.
TARGETS = ["deploy", "discord", "frontend", "sql"]

# Request kinds and their parameters as (name, type, required).
# Kinds of the sql member are entity/query name.
REQUESTS = {
    "sql": {
        "chall/create": [
            ("id", "id", False),
            ("name", "text", True),
            ("description", "text", True),
            ("points", "int", True),
            ("authors", "texts", True),
            ("hints", "texts", True),
            ("categories", "texts", True),
            ("tags", "texts", True),
            ("links", "links", True),
            ("visible", "flag", True),
            ("source_folder", "text", True),
            ("flag", "text", True),
        ],
        "chall/update": [
            ("id", "id", True),
            ("name", "text", False),
            ("description", "text", False),
            ("points", "int", False),
            ("authors", "texts", False),
            ("hints", "texts", False),
            ("categories", "texts", False),
            ("tags", "texts", False),
            ("links", "links", False),
            ("visible", "flag", False),
            ("source_folder", "text", False),
        ],
        "chall/get": [("id", "id", True)],
        "chall/get_all": [],
        "team/available": [("name", "text", True)],
        "team/create": [
            ("name", "text", True),
            ("description", "text", True),
            ("eligible", "flag", True),
            ("affiliation", "text", False),
            ("password", "text", True),
            ("initial_user", "id", True),
            ("user_auth", "auth", True),
        ],
        "team/update": [
            ("id", "id", True),
            ("name", "text", False),
            ("description", "text", False),
            ("eligible", "flag", False),
            ("affiliation", "text", False),
            ("password", "text", True),
        ],
        "team/get": [("id", "id", True)],
        "team/get_all": [],
        "team/get_top": [("limit", "size", True)],
        "team/get_top_history": [("limit", "size", True), ("start_time", "time", True)],
        "user/available": [("name", "text", True)],
        "user/create": [
            ("email", "text", True),
            ("name", "text", True),
            ("eligible", "flag", True),
            ("admin", "flag", True),
            ("auth", "auth", True),
        ],
        "user/promote": [("admin_id", "id", True), ("admin_auth", "auth", True), ("user_to_promote", "id", True)],
        "user/check_auth": [("id", "id", True), ("auth", "auth", True)],
        "user/update_auth": [("id", "id", True), ("old_auth", "auth", True), ("new_auth", "auth", True)],
        "user/join": [
            ("id", "id", True),
            ("auth", "auth", True),
            ("team_name", "text", True),
            ("team_pass", "text", True),
        ],
        "user/get": [("id", "id", True)],
        "user/get_all": [],
        "solve/get_all": [],
        "solve/get": [("id", "id", True)],
        "solve/get_chall": [("chall_id", "id", True)],
        "solve/get_team": [("team_id", "id", True)],
        "solve/get_user": [("user_id", "id", True)],
        "solve/attempt": [
            ("user_id", "id", True),
            ("team_id", "id", True),
            ("chall_id", "id", True),
            ("user_auth", "auth", True),
            ("flag_guess", "text", True),
        ],
        "solve/clear_all_chall": [("id", "id", True)],
    },
    "deploy": {
        "deploy": [("chall", "text", True), ("force_wipe", "flag", True)],
        "poll": [("id", "id", True)],
        "remove": [("chall", "id", True)],
        "modify_meta": [
            ("id", "id", True),
            ("name", "text", False),
            ("desc", "text", False),
            ("points", "u64", False),
            ("categories", "texts", False),
            ("tags", "texts", False),
            ("visible", "flag", False),
        ],
        "list_challs": [],
    },
    "discord": {
        "developer": [
            ("level", "level", True),
            ("message", "text", True),
            ("data", "any", True),
            ("include_chall_writers", "flag", True),
        ],
        "participant/first_blood": [("chall_name", "text", True), ("team", "text", True), ("user", "text", True)],
        "participant/alert": [("message", "text", True)],
    },
    "frontend": {
        "sync/chall": [("id", "id", True)],
        "sync/all_challs": [],
        "sync/user": [("id", "id", True)],
        "sync/all_users": [],
        "sync/team": [("id", "id", True)],
        "sync/all_teams": [],
        "sync/solves": [],
        "sync/all": [],
    },
}

TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?$"

SPARK_TYPES = {
    "text": "string", "int": "int", "size": "bigint", "u64": "decimal(20,0)", "flag": "boolean", "texts": "array<string>",
    "links": "array<struct<type:string,location:string>>", "time": "timestamp_ntz", "level": "string",
    "any": "variant",
}


def parameters(target: str, kind: str) -> list[tuple[str, str, bool]]:
    """(name, type, required) of one request kind."""
    return REQUESTS[target][kind]


def _specification() -> Column:
    """Parameters of every kind as one constant map, keyed by target:kind."""
    spec = {
        f"{target}:{kind}": [{"name": n, "type": t, "required": r} for n, t, r in parameters(target, kind)]
        for target in TARGETS
        for kind in REQUESTS[target]
    }
    return F.from_json(F.lit(json.dumps(spec)), "map<string,array<struct<name:string,type:string,required:boolean>>>")


def requests_ddl(id_type: str = "string") -> str:
    return f"request_id {id_type}, body string, received_at timestamp_ntz"


def read_requests(spark: SparkSession, path: str, fmt: str = "json", id_type: str = "string") -> DataFrame:
    """Requests (request_id, body, received_at) from files, one per row; ``streaming.sources.read_requests`` is the live
    form."""
    return spark.read.schema(requests_ddl(id_type)).format(fmt).load(path)


def _get(v: Column, path: str, type_: str = "variant") -> Column:
    return F.try_variant_get(v, path, type_)


def _absent(v: Column) -> Column:
    """Missing, or an explicit JSON null."""
    return F.coalesce(v.isNull() | F.is_variant_null(v), F.lit(True))


def _yes(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _all_text(v: Column, *names: str) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & _yes(F.schema_of_variant(_get(v, f"$.{name}")) == "STRING")
    return out


def _auth_ok(v: Column) -> Column:
    tag, p = _get(v, "$.__type", "string"), _get(v, "$.params")
    oauth = tag.isin("o_auth", "oauth") & _all_text(p, "sub", "provider", "oauth_allow_token")
    return oauth | ((tag == "pass") & _all_text(p, "password"))


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and pass it on; a lambda body computes a repeated expression each time."""
    return F.get(F.transform(F.array(value), use), 0)


def _type_ok(v: Column, shape: Column, type_: Column, id_type: str) -> Column:
    """Does the present value ``v``, of JSON type ``shape``, have the named type?"""
    is_text = shape == "STRING"
    text, number = _get(v, "$", "string"), _get(v, "$", "bigint")
    whole = (shape == "BIGINT") | shape.rlike(r"^DECIMAL\(\d+,0\)$")
    id_ok = shape == "BIGINT" if id_type == "bigint" else is_text & text.rlike(UUID)
    link_ok = F.forall(
        _get(v, "$", SPARK_TYPES["links"]), lambda x: _yes(x["type"].isin(*LINK_TYPES) & x["location"].isNotNull())
    )
    return _yes(
        F.when(type_ == "text", is_text)
        .when(type_ == "id", id_ok)
        .when(type_ == "flag", shape == "BOOLEAN")
        .when(type_ == "int", (shape == "BIGINT") & number.between(-(2**31), 2**31 - 1))
        .when(type_ == "size", (shape == "BIGINT") & number.between(0, 2**32 - 1))
        .when(type_ == "u64", whole & _get(v, "$", "decimal(38,0)").between(0, F.lit(Decimal(2**64 - 1))))
        .when(type_ == "texts", shape.isin("ARRAY<STRING>", "ARRAY<VOID>"))
        .when(type_ == "auth", _auth_ok(v))
        .when(type_ == "links", link_ok)
        .when(type_ == "time", is_text & text.rlike(TIME) & _get(v, "$", "timestamp_ntz").isNotNull())
        .when(type_ == "level", is_text & text.isin(*ALERT_LEVELS))
    )


BODY = (
    "deploy struct<__type:string,data:variant>, discord struct<__type:string,details:variant>, "
    "frontend struct<__type:string,data:variant>, "
    "sql struct<__type:string,details:struct<__query_name:string,params:variant>>, _corrupt_record string"
)


def _member(target: str) -> Column:
    """(target, kind, params) of one member: the tags joined by "/", and the object with the parameters."""
    m = F.col(f"_body.{target}")
    tag = m["__type"]
    if target == "sql":
        kind, params = F.concat_ws("/", tag, m["details"]["__query_name"]), m["details"]["params"]
    elif target == "deploy":
        kind, params = tag, m["data"]
    elif target == "frontend":
        # The id of a sync stands beside its tag, not in a parameter object.
        kind, params = F.concat_ws("/", tag, _get(m["data"], "$.__sync_type", "string")), m["data"]
    else:
        guest = tag == "participant"
        details = m["details"]
        both = F.concat_ws("/", tag, _get(details, "$.__participant_message_type", "string"))
        kind = F.when(guest, both).otherwise(tag)
        params = F.when(guest, _get(details, "$.metadata")).otherwise(details)
    parts = F.struct(F.lit(target).alias("target"), kind.alias("kind"), params.alias("params"))
    return F.when(m.isNotNull(), parts)


def _members(requests: DataFrame) -> DataFrame:
    """Requests (request_id, body) with ``members``: the present ones in target order, null if the body is malformed.

    A member that is an explicit JSON null counts as absent.
    """
    parsed = requests.withColumn("_body", F.from_json("body", BODY))
    broken = F.col("_body").isNull() | F.col("_body._corrupt_record").isNotNull()
    present = F.array_compact(F.array(*[_member(t) for t in TARGETS]))
    return parsed.select("request_id", F.when(~broken, present).alias("members"))


def _rows(df: DataFrame, members: Column) -> DataFrame:
    # The outer form keeps the planner from filtering on the members first, which would parse every body twice.
    return df.select("request_id", F.inline_outer(members)).where("target is not null")


def fan_out(requests: DataFrame) -> DataFrame:
    """One row per request and present member: (request_id, target, kind, params)."""
    return _rows(_members(requests), F.col("members"))


def judge(requests: DataFrame, id_type: str = "string") -> DataFrame:
    """(request_id, members, reason): ``reason`` is null for a good request, else malformed or bad_<target>.

    One bad member refuses the whole request; the first one in target order gives the reason.
    """
    spec = _specification()

    def fits(p: Column, v: Column) -> Column:
        typed = _let(F.schema_of_variant(v), lambda shape: _type_ok(v, shape, p["type"], id_type))
        return (
            F.when(p["type"] == "any", v.isNotNull())
            .when(_absent(v), ~p["required"])
            .otherwise(typed)
        )

    def good(m: Column) -> Column:
        wanted = F.try_element_at(spec, F.concat_ws(":", m["target"], m["kind"]))
        given = F.try_variant_get(m["params"], "$", "map<string,variant>")

        def all_fit(g: Column) -> Column:
            return F.forall(wanted, lambda p: _let(F.try_element_at(g, p["name"]), lambda v: fits(p, v)))

        return _yes(_let(given, all_fit))

    bad = F.get(F.transform(F.filter("members", lambda m: ~good(m)), lambda m: m["target"]), 0)
    reason = F.when(F.col("members").isNull(), "malformed").otherwise(F.concat(F.lit("bad_"), bad))
    return _members(requests).withColumn("reason", reason)


def route(requests: DataFrame, id_type: str = "string") -> tuple[DataFrame, DataFrame]:
    """Rows (request_id, target, kind, params) of the good requests, and (request_id, reason) of the others."""
    judged = judge(requests, id_type)
    accepted = _rows(judged, F.when(F.col("reason").isNull(), F.col("members")))
    refused = judged.select("request_id", F.explode_outer(F.array("reason")).alias("reason"))
    return accepted, refused.where("reason is not null")


def commands(routed: DataFrame, target: str, kind: str, id_type: str = "string") -> DataFrame:
    """Typed rows of one kind: request_id and one column per parameter.

    Text ids get the one spelling of a uuid. Credentials become ``<name>_type``, ``<name>_sub`` and ``<name>_provider``; passwords and tokens are not read.
    """
    own = routed.where((F.col("target") == target) & (F.col("kind") == kind))
    p = F.col("params")
    cols = [F.col("request_id")]
    for name, type_, _ in parameters(target, kind):
        if type_ == "auth":
            tag = _get(p, f"$.{name}.__type", "string")
            cols.append(F.when(tag == "pass", "pass").otherwise("oauth").alias(f"{name}_type"))
            cols += [_get(p, f"$.{name}.params.{x}", "string").alias(f"{name}_{x}") for x in ("sub", "provider")]
        else:
            value = _get(p, f"$.{name}", id_type if type_ == "id" else SPARK_TYPES[type_])
            cols.append((uuid_of(value) if type_ == "id" and id_type == "string" else value).alias(name))
    return own.select(*cols)
