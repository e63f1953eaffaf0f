from __future__ import annotations

import json

import pytest
from helpers import as_dict, as_set, frame

from solvelake.sources import envelope

ID = "0b9f2c1e-1111-2222-3333-444455556666"
SAMPLES = {
    "id": ID,
    "text": "some text",
    "int": 5,
    "u64": 2**63,
    "size": 50,
    "flag": True,
    "texts": ["a"],
    "links": [{"type": "web", "location": "x"}],
    "time": "2024-01-15T10:00:00",
    "level": "WARN",
    "any": {"k": [1]},
    "auth": {"__type": "o_auth", "params": {"sub": "s", "provider": "p", "oauth_allow_token": "t"}},
}
WRONG = {
    "id": "zz", "text": 5, "int": 2**31, "size": -1, "u64": 2**64, "flag": "true", "texts": "a",
    "links": [{"type": "ftp", "location": "x"}], "time": "yesterday", "level": "info",
    "auth": {"__type": "o_auth", "params": {"sub": "s"}},
}


def body(target, kind, params):
    first, _, second = kind.partition("/")
    if target == "sql":
        inner = {"__query_name": second, "params": params}
        return {"sql": {"__type": first, "details": inner}}
    if target == "deploy":
        return {"deploy": {"__type": first, "data": params}}
    if target == "frontend":
        return {"frontend": {"__type": first, "data": {"__sync_type": second, **params}}}
    if second:
        return {"discord": {"__type": first, "details": {"__participant_message_type": second, "metadata": params}}}
    return {"discord": {"__type": first, "details": params}}


def test_every_kind_with_and_without_each_parameter(spark):
    rows, want, n = [], {}, 0

    def add(target, kind, params, good):
        nonlocal n
        n += 1
        rows.append((n, json.dumps(body(target, kind, params))))
        want[n] = None if good else f"bad_{target}"

    for target, kinds in envelope.REQUESTS.items():
        for kind in kinds:
            spec = envelope.parameters(target, kind)
            full = {name: SAMPLES[type_] for name, type_, _ in spec}
            add(target, kind, full, True)
            add(target, kind, {name: SAMPLES[t] for name, t, required in spec if required}, True)
            add(target, kind + "x", full, False)
            for name, type_, required in spec:
                add(target, kind, {k: v for k, v in full.items() if k != name}, not required)
                if type_ != "any":
                    add(target, kind, {**full, name: None}, not required)
                    add(target, kind, {**full, name: WRONG[type_]}, False)
    judged = envelope.judge(frame(spark, rows, "request_id int, body string"))
    got = as_dict(judged, "request_id", "reason")
    bodies = dict(rows)
    assert {i: (got[i], want[i], bodies[i]) for i in got if got[i] != want[i]} == {}
    assert len(envelope.REQUESTS["sql"]) == 26


def test_fan_out_and_quarantine(spark):
    ok = body("sql", "team/get_all", {})
    rows = [
        (1, json.dumps({**ok, **body("deploy", "poll", {"id": ID}), "discord": None, "other": 1})),
        (2, "{"),
        (3, "[1]"),
        (4, "{}"),
        (5, json.dumps({**ok, **body("frontend", "sync/chall", {})})),
        (6, None),
        (7, json.dumps({"sql": {"__type": "solve", "details": {"__query_name": "get_all"}}})),
    ]
    df = frame(spark, rows, "request_id int, body string")
    assert as_set(envelope.fan_out(df).where("request_id < 5"), "request_id", "target", "kind") == {
        (1, "deploy", "poll"), (1, "sql", "team/get_all")
    }
    accepted, refused = envelope.route(df)
    assert as_set(accepted, "request_id", "kind") == {(1, "poll"), (1, "team/get_all"), (7, "solve/get_all")}
    assert as_dict(refused, "request_id", "reason") == {
        2: "malformed", 3: "malformed", 5: "bad_frontend", 6: "malformed"
    }


def test_typed_commands(spark):
    params = {
        "id": None, "name": "n", "description": "d", "points": 7, "authors": ["a", "b"], "hints": [], "categories": [],
        "tags": [], "links": [{"type": "nc", "location": "l"}], "visible": False, "source_folder": "f", "flag": "x",
    }
    auth = {"__type": "pass", "params": {"password": "secret"}}
    rows = [
        (1, json.dumps(body("sql", "chall/create", params))),
        (2, json.dumps(body("sql", "team/get_top_history", {"limit": 10, "start_time": "2024-01-15T10:00:00.5"}))),
        (3, json.dumps(body("sql", "user/check_auth", {"id": ID, "auth": auth}))),
    ]
    accepted, refused = envelope.route(frame(spark, rows, "request_id int, body string"))
    assert refused.count() == 0
    c = envelope.commands(accepted, "sql", "chall/create").first()
    assert (c.id, c.points, c.authors, c.visible, c.links[0].location) == (None, 7, ["a", "b"], False, "l")
    h = envelope.commands(accepted, "sql", "team/get_top_history")
    assert h.schema["limit"].dataType.simpleString() == "bigint" and h.first().start_time.microsecond == 500000
    a = envelope.commands(accepted, "sql", "user/check_auth")
    assert a.columns == ["request_id", "id", "auth_type", "auth_sub", "auth_provider"]
    assert a.first().auth_type == "pass" and "secret" not in str(a.first())


@pytest.mark.parametrize("id_type,value,good", [("bigint", 5, True), ("bigint", ID, False), ("string", 5, False)])
def test_id_types(spark, id_type, value, good):
    df = frame(spark, [(1, json.dumps(body("sql", "team/get", {"id": value})))], "request_id int, body string")
    assert (envelope.judge(df, id_type).first().reason is None) == good
