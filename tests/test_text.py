from __future__ import annotations

import json
import random
from decimal import ROUND_HALF_UP, Decimal

from helpers import as_dict, as_list, frame
from pyspark.sql import functions as F

from solvelake.functions import text
from solvelake.functions.common import epoch, stable_id, to_second
from solvelake.operators import deploys
from solvelake.sources import responses


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_shortened(spark):
    names = ["abc", "x" * 12, "x" * 13, "abcdefghijklmnop", "a\tb\n'\"\\", "\x1b[0m" + "y" * 20, "", "\0"]
    df = frame(spark, [(i, n) for i, n in enumerate(names)], "i int, n string")
    got = as_dict(df.withColumn("s", text.shortened("n", 13)), "i", "s")
    assert got == {
        0: "abc",
        1: "x" * 12,
        2: "x" * 10 + "...",
        3: "abcdefghij...",
        4: "a\\tb\\n\\'\\\"\\\\",
        5: "\\u{1b}[0m" + "y" * 6 + "...",
        6: "",
        7: "\\0",
    }


def test_messages(spark):
    got = one(
        spark,
        text.first_blood_message(F.lit("c`h"), F.lit("t`m"), F.lit("u`r")),
        text.staff_alert(F.lit("WARN"), F.lit("body"), F.lit(True), "1", "2"),
        text.staff_alert(F.lit("ERROR"), F.lit("body"), F.lit(False), "1", "2"),
        text.sync_event(F.lit("chall"), F.lit("x")),
        text.sync_event(F.lit("all"), F.lit("x")),
        text.sync_error_body(F.lit("team"), F.lit("x")),
        text.sync_forward_error_body(F.lit("down")),
        text.notify_error_body(F.lit(429), F.lit("slow"), F.lit("b")),
    )
    assert got == (
        "First :drop_of_blood: by `u'r` from `t'm` on challenge `c`h`!",
        "-------------------\n# Urgency: Warn \n<@&1> <@&2> \nbody",
        "-------------------\n# Urgency: Error\n<@&2> \nbody",
        '{"__type":"chall","id":"x"}',
        '{"__type":"all"}',
        '{"message":"failed to sync","sync_type":{"type":"team","id":"x"}}',
        '{"message":"failed to forward the sync req","reason":"down"}',
        '{"message":"failed to send discord message","code":429,"status_message":"slow","body":"b"}',
    )


def test_one_decimal_is_exact(spark):
    rng = random.Random(4)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.95, 0.949999, 6.55, 1.05, 2.5, 1e9 + 0.25, 0.04999999999999999]
    values += [rng.uniform(0, 1000) for _ in range(200)] + [rng.randrange(20000) / 100 for _ in range(300)]
    df = frame(spark, [(i, v) for i, v in enumerate(values)], "i int, v double")
    got = as_dict(df.withColumn("s", text.one_decimal(F.col("v"))), "i", "s")
    # Decimal(float) is the exact binary value.
    assert got == {i: str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)) for i, v in enumerate(values)}


def test_status_line(spark):
    df = frame(spark, [("success", 3, 250000000), ("uploadingslow", 0, 0)], "s string, secs long, nanos int")
    assert as_list(df.select(text.status_line("s", "secs", "nanos").alias("x")), "x") == [
        ("  success for 3.3 seconds",), ("uploadingslow for 0.0 seconds",)
    ]


def test_errors(spark):
    kind = F.col("k")
    detail = [F.lit(v) for v in ("why", "id1", "n1")] + [F.lit(500), F.lit(100)]
    df = frame(spark, [(k,) for k in text.TABLE_ERRORS], "k string").select(
        "k",
        text.table_error_status(kind).alias("status"),
        text.table_error_body(kind, *detail).alias("body"),
        text.table_error_data(kind, *detail).alias("data"),
    )
    got = {r.k: (r.status, json.loads(r.body), json.loads(r.data)) for r in df.collect()}
    assert got["OtherServerError"][0] == 500 and got["OtherServerError"][1]["info"] == "why"
    assert got["DatabaseError"][1:] == ({"err": "Unexpected database error encountered."}, "DatabaseError")
    assert got["Auth"][0] == 403 and got["Auth"][2] == "Auth"
    assert got["DoesNotExist"][0] == 404 and got["DoesNotExist"][2] == {"DoesNotExist": "id1"}
    assert got["NameDoesNotExist"][1]["name"] == "n1"
    assert got["NameIsTaken"][0] == 400
    assert got["RequestTooBig"][0] == 413 and got["RequestTooBig"][2] == {"RequestTooBig": [500, 100]}
    d = frame(spark, [("BadSend",), ("DeployServer",)], "k string").select(
        "k", text.deploy_error_status(kind, F.lit(418)).alias("s"), text.deploy_error_body(kind, F.lit("tea")).alias("b")
    )
    assert as_dict(d, "k", "s", "b") == {
        "BadSend": (500, "Failed to forward request to the deploy server"), "DeployServer": (418, "tea")
    }


def test_status_rollup_and_responses(spark):
    rows = [
        (1, "sql", 200), (1, "discord", 204),
        (2, "deploy", 404), (2, "sql", 503), (2, "discord", 500),
        (3, "frontend", 413), (3, "sql", 403),
        (4, "discord", 302),
    ]
    df = frame(spark, rows, "request_id int, target string, code int")
    assert as_dict(responses.request_status(df), "request_id", "status") == {1: 200, 2: 500, 3: 413, 4: 500}
    out = responses.assemble(df.withColumn("result", responses.success("x", F.col("code"))))
    got = {r.request_id: (r.status, json.loads(r.response)) for r in out.collect()}
    assert got[4] == (500, {
        "deploy": None, "discord": {"ok": "success", "data": {"__type": "x", "data": 302}}, "frontend": None, "sql": None
    })


def test_ids_and_times(spark):
    uuid = "0B9F2C1E-1111-2222-3333-444455556666"
    asks = frame(
        spark, [(1, uuid, False), (2, "chall/a", False), (3, "chall/a", True), (4, "zzz", False)],
        "request_id long, chall string, force_wipe boolean",
    )
    c = frame(spark, [("id-a", "chall/a")], "id string, source_folder string")
    got = as_dict(deploys.deploy_ids(asks, c), "request_id", "deploy_id")
    assert got[1] == uuid.lower() and got[2] == "id-a"
    assert len(got[3]) == 36 and len(got[4]) == 36 and got[3] != got[4]
    a, b, c = one(spark, stable_id("k", F.lit(1)), stable_id("k", F.lit(1)), stable_id("j", F.lit(1)))
    assert a == b != c
    none = F.lit(None).cast("string")
    lists = [["a|b", "c"], ["a", "b|c"], ["u", none], ["u"], ["u", "-"], [none, "u"], ["u", ""], ["1:a"], ["a"]]
    made = one(spark, *[stable_id("k", *[F.lit(p) if isinstance(p, str) else p for p in parts]) for parts in lists])
    assert len(set(made)) == len(lists)
    half = F.lit("2024-01-01 00:00:00.5").cast("timestamp_ntz")
    less = F.lit("2024-01-01 00:00:00.499999").cast("timestamp_ntz")
    assert one(spark, epoch(to_second(half)), epoch(to_second(less))) == (1704067201, 1704067200)
    names = frame(spark, [("a,b",), ("c",)], "n string")
    assert as_list(names.select(text.split_names("n").alias("x")), "x") == [("a",), ("b",), ("c",)]


def test_latest_status(spark):
    log = frame(
        spark, [(1, "a", "started", 0.0, 5), (3, "a", "success", 2.0, 7), (2, "a", "building", 1.0, 7), (9, "b", "x", 0.0, 1)],
        "seq long, chall string, status string, status_time double, ts int",
    )
    assert as_dict(deploys.latest_statuses(log), "chall", "status") == {"a": "success", "b": "x"}
