from __future__ import annotations

import json

from helpers import as_dict, frame

from solvelake.functions.common import uuid_of
from solvelake.sources import envelope

ONE = "0f8fad5b-d9cb-469f-a165-70867728950e"


def test_spellings(spark):
    plain = ONE.replace("-", "")
    texts = [ONE, ONE.upper(), plain, plain.upper(), "{" + ONE + "}", "urn:uuid:" + ONE]
    wrong = [plain[:-1], ONE[:8] + ONE[9:], "chall/x", "", None, "{" + plain + "}", ONE + " "]
    df = frame(spark, list(enumerate([*texts, *wrong])), "i int, t string")
    got = as_dict(df.select("i", uuid_of("t").alias("u")), "i", "u")
    assert [got[i] for i in range(len(texts))] == [ONE] * len(texts)
    assert [got[len(texts) + i] for i in range(len(wrong))] == [None] * len(wrong)


def test_points_and_ids_of_requests(spark):
    def body(points, id_=ONE.upper()):
        return json.dumps({"deploy": {"__type": "modify_meta", "data": {"id": id_, "points": points}}})

    points = [0, 2**32, 2**63, 2**64 - 1, 2**64, -1, 1.5, None]
    requests = frame(spark, [(i, body(p)) for i, p in enumerate(points)], "request_id long, body string")
    accepted, refused = envelope.route(requests)
    rows = as_dict(envelope.commands(accepted, "deploy", "modify_meta"), "request_id", "points", "id")
    assert rows == {i: (points[i], ONE) for i in (0, 1, 2, 3, 7)}
    assert set(as_dict(refused, "request_id", "reason")) == {4, 5, 6}
