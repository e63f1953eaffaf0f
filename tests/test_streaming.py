from __future__ import annotations

import json
import random

import pytest
from helpers import as_dict, as_set, frame, ts
from pyspark.sql import functions as F

from solvelake.operators import ledger as batch
from solvelake.operators import scores
from solvelake.sources import buckets, envelope
from solvelake.streaming import changes, ledger, sources, status

ATTEMPT = "id long, user_id long, team_id long, challenge_id long, correct boolean, inserted_at timestamp_ntz"


def rows(n=300, seed=2):
    rng = random.Random(seed)
    return [
        (i, rng.randrange(9), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3]), rng.random() < 0.4, ts(rng.randrange(500)))
        for i in range(n)
    ]


def write_batches(spark, path, batches, ddl=ATTEMPT):
    """One file per micro-batch; the stream takes the oldest file first."""
    for i, part in enumerate(batches):
        frame(spark, part, ddl).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")


def stream(spark, path, ddl=ATTEMPT):
    return sources.read_files(spark, f"{path}/*", ddl, per_trigger=1)


def run(q):
    assert q.awaitTermination(120), "the stream did not end"


def want(parts, spark):
    return as_set(
        batch.first_correct(frame(spark, [r for p in parts for r in p], ATTEMPT)),
        "attempt_id", "user_id", "challenge_id", "team_id", "solved_at",
    )


def split(data, n):
    return [data[i::n] for i in range(n)]


def test_event_time_ledger_under_any_split(spark, tmp_path):
    data = sorted(rows(), key=lambda r: r[5], reverse=True)  # the latest attempts arrive first
    parts = [data[:120], data[120:200], data[200:]]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_batches(spark, src, parts)
    s = stream(spark, src)
    run(ledger.start_ledger(s, out, str(tmp_path / "cp"), ledger.EVENT_TIME))
    got = ledger.read_ledger(spark, out, s, ledger.EVENT_TIME)
    assert as_set(got, "attempt_id", "user_id", "challenge_id", "team_id", "solved_at") == want(parts, spark)


def test_arrival_ledger_keeps_the_first_comer(spark, tmp_path):
    parts = [[(1, 1, 1, 1, True, ts(100)), (2, 1, 1, 1, True, ts(90))], [(3, 1, 1, 1, True, ts(5)), (4, 1, 2, 1, True, ts(6))]]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_batches(spark, src, parts)
    s = stream(spark, src)
    run(ledger.start_arrivals(s, out, str(tmp_path / "cp")))
    assert as_dict(ledger.read_arrivals(spark, out, s), "id", "counted", "batch_id") == {
        1: (False, 0), 2: (True, 0), 3: (False, 1), 4: (True, 1)
    }
    # Ordered by event time the late attempt would have won.
    assert as_set(batch.first_correct(frame(spark, parts[0] + parts[1], ATTEMPT)), "attempt_id") == {(3,), (4,)}


def test_restart_goes_on_and_a_repeated_batch_overwrites(spark, tmp_path):
    parts = split(rows(200, 5), 2)
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    write_batches(spark, src, parts[:1])
    s = stream(spark, src)
    run(ledger.start_ledger(s, out, cp, ledger.EVENT_TIME))
    schema = ledger.running_ledger(s, ledger.EVENT_TIME).schema
    first = changes.read_log(spark, out, schema)
    # The same batch written once more, as after a failure between the write and the commit.
    first.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "copy"))
    spark.read.schema(schema).parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(changes.batch_path(out, 0))
    frame(spark, parts[1], ATTEMPT).coalesce(1).write.parquet(f"{src}/part=1")
    run(ledger.start_ledger(stream(spark, src), out, cp, ledger.EVENT_TIME))
    got = ledger.read_ledger(spark, out, s, ledger.EVENT_TIME)
    assert as_set(got, "attempt_id", "user_id", "challenge_id", "team_id", "solved_at") == want(parts, spark)


def test_unchanged_winners_are_not_written_again_and_snapshots_fold(spark, tmp_path):
    parts = [
        [(1, 1, 1, 1, True, ts(50)), (2, 1, 2, 1, True, ts(60))], [(3, 2, 1, 1, True, ts(70))], [(4, 2, 1, 1, True, ts(20))],
        [(5, 2, 3, 2, True, ts(20))], [(6, 2, 2, 1, True, ts(61))],
    ]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_batches(spark, src, parts)
    s = stream(spark, src)
    run(ledger.start_ledger(s, out, str(tmp_path / "cp"), ledger.EVENT_TIME, compact_every=2))
    written = spark.read.parquet(out).groupBy("batch_id").count()
    assert as_dict(written, "batch_id", "count") == {2: 1, 3: 1}  # the first two are behind a snapshot
    assert sorted(changes._snapshots(spark, out)) == [1, 3]
    got = ledger.read_ledger(spark, out, s, ledger.EVENT_TIME)
    assert as_set(got, "attempt_id", "user_id", "challenge_id", "team_id", "solved_at") == want(parts, spark)
    before = ledger.read_ledger(spark, out, s, ledger.EVENT_TIME, upto=1)
    assert as_set(before, "attempt_id") == {(1,), (2,)}


@pytest.fixture
def tables(spark):
    teams = frame(
        spark, [(i, f"t{i}", True, None, ts(i)) for i in (1, 2, 3, 4)],
        "id long, name string, eligible boolean, affiliation string, inserted_at timestamp_ntz",
    )
    challenges = frame(spark, [(i, f"c{i}", 10 * i) for i in (1, 2, 3)], "id long, name string, points int")
    users = frame(spark, [(i, f"u{i}") for i in range(9)], "id long, name string")
    return teams, challenges, users


def test_leaderboard_over_batches(spark, tmp_path, tables):
    teams, challenges, _ = tables
    parts = split(rows(60, 8), 3)
    src = str(tmp_path / "in")
    write_batches(spark, src, parts)
    paths = [str(tmp_path / x) for x in ("ledger", "scores", "board", "cp")]
    run(ledger.start_leaderboard(stream(spark, src), teams, challenges, *paths, 3))
    led = batch.first_correct(frame(spark, [r for p in parts for r in p], ATTEMPT))
    total = scores.team_scores(teams, led, challenges)
    top = ledger.top_of(teams, total, 3)
    board = ledger.latest_board(spark, paths[2], 3, "bigint")
    assert as_dict(board, "rank", "id", "score", "last_solve") == as_dict(top, "rank", "id", "score", "last_solve")


def test_first_bloods_are_told_once(spark, tmp_path, tables):
    teams, challenges, users = tables
    parts = [
        [(1, 1, 1, 1, True, ts(50)), (2, 2, 2, 1, True, ts(60))],
        [(3, 3, 2, 1, True, ts(10)), (4, 4, 3, 2, True, ts(20)), (5, 4, 3, 3, False, ts(1))],
    ]
    src = str(tmp_path / "in")
    write_batches(spark, src, parts)
    paths = [str(tmp_path / x) for x in ("bloods", "outbox", "cp")]
    run(ledger.start_first_bloods(stream(spark, src), challenges, teams, users, *paths))
    out = ledger.read_outbox(spark, paths[1], "bigint")
    assert as_dict(out, "attempt_id", "content", "batch_id") == {
        1: ("First :drop_of_blood: by `u1` from `t1` on challenge `c1`!", 0),
        4: ("First :drop_of_blood: by `u4` from `t3` on challenge `c2`!", 1),
    }


def test_status_over_batches(spark, tmp_path):
    ddl = "seq long, chall long, status string, status_time double, ts timestamp_ntz"
    parts = [[(1, 1, "started", 0.0, ts(1)), (5, 1, "success", 2.0, ts(9))], [(3, 1, "building", 1.0, ts(5)), (4, 2, "failure", 1.0, ts(2))]]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_batches(spark, src, parts, ddl)
    log = stream(spark, src, ddl)
    run(status.start_status(log, out, str(tmp_path / "cp")))
    assert as_dict(status.read_status(spark, out, log), "chall", "status") == {1: "success", 2: "failure"}


def test_a_batch_of_events_has_files_as_its_rows_grow(spark, tmp_path, monkeypatch):
    from solvelake.plans import live

    sf = "/root/testdata/sf0.001"
    want = as_set(live.stream_first_correct(spark, sf), "id", "batch_id", "correct", "counted")
    path = str(tmp_path / "events")
    total = live.tb.raw(spark, sf, "events").count()
    monkeypatch.setattr(live, "FILE_ROWS", total // 12)
    with monkeypatch.context() as m:
        m.setattr(live, "work_path", lambda *_: path)
        live.events(spark, sf)
    files = [len(list((tmp_path / "events" / f"part={i}").glob("*.parquet"))) for i in range(live.BATCHES)]
    assert files == [3] * live.BATCHES
    assert as_set(live.stream_first_correct(spark, sf), "id", "batch_id", "correct", "counted") == want


def test_arrivals_go_on_after_a_restart_and_from_an_earlier_ledger(spark, tmp_path):
    """State outlives the query: nothing written before is read, and pairs of an earlier ledger count no more."""
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    write_batches(spark, src, [[(1, 1, 1, 1, True, ts(9)), (2, 1, 1, 2, None, ts(1)), (3, 1, 3, 3, True, ts(2))]])
    earlier = frame(spark, [(99, 1, 3, 3, ts(0))], "attempt_id long, user_id long, challenge_id long, team_id long, solved_at timestamp_ntz")
    run(ledger.start_arrivals(stream(spark, src), out, cp, earlier))
    changes._drop(spark, out)
    frame(spark, [(4, 1, 1, 1, True, ts(0)), (5, 2, 1, 2, True, ts(7)), (6, 2, 1, 2, True, ts(7))], ATTEMPT).coalesce(1).write.parquet(f"{src}/part=1")
    run(ledger.start_arrivals(stream(spark, src), out, cp, earlier))
    got = as_dict(ledger.read_arrivals(spark, out, stream(spark, src)), "id", "counted", "batch_id")
    assert got == {4: (False, 1), 5: (True, 1), 6: (False, 1)}


def test_folders_stay_few_over_many_batches(spark, tmp_path, monkeypatch):
    """Folders behind a finished snapshot go, and the ledger stays whole, also for a batch that is repeated."""
    data = rows(160, 11)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_batches(spark, src, split(data, 20))
    s = stream(spark, src)
    run(ledger.start_ledger(s, out, str(tmp_path / "cp"), ledger.EVENT_TIME, compact_every=4))
    assert len(changes._listed(spark, out, "batch_id")) <= 7
    assert changes._snapshots(spark, out) == [15, 19]
    got = ledger.read_ledger(spark, out, s, ledger.EVENT_TIME)
    assert as_set(got, "attempt_id", "user_id", "challenge_id", "team_id", "solved_at") == want([data], spark)
    again = ledger.read_ledger(spark, out, s, ledger.EVENT_TIME, upto=18)
    seen = [r for part in split(data, 20)[:19] for r in part]
    assert as_set(again, "attempt_id", "user_id", "challenge_id", "team_id", "solved_at") == want([seen], spark)


def test_bounded_state(spark, tmp_path):
    """Late attempts within the bound count, later ones do not, and state of spans that are over goes."""
    day = 86_400
    parts = [
        [(1, 1, 1, 1, True, ts(50_000)), (2, 2, 2, 2, True, ts(100))],
        [(3, 1, 1, 1, True, ts(40_000)), (4, 1, 5, 5, True, ts(3 * day))],
        [(5, 1, 6, 6, True, ts(3 * day + 5))],
        [(6, 1, 1, 1, True, ts(10)), (7, 1, 5, 5, True, ts(3 * day - 20)), (8, 3, 7, 7, True, ts(3 * day + 9))],
    ]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_batches(spark, src, parts)
    s = stream(spark, src)
    q = ledger.start_ledger(s, out, str(tmp_path / "cp"), ledger.EVENT_TIME, changes.Bound("inserted_at"))
    run(q)
    got = ledger.read_ledger(spark, out, s, ledger.EVENT_TIME)
    assert as_set(got, "attempt_id") == {(3,), (2,), (7,), (5,), (8,)}
    assert sum(p["stateOperators"][0]["numRowsRemoved"] for p in q.recentProgress if p["stateOperators"]) >= 2


def test_leaderboard_writes_the_touched_buckets_only(spark, tmp_path, tables):
    teams, challenges, _ = tables
    paths = [str(tmp_path / x) for x in ("ledger", "scores", "board", "cp")]
    src = str(tmp_path / "in")
    parts = [[(1, 1, 1, 1, True, ts(50)), (2, 2, 2, 1, True, ts(60))], [(3, 3, 2, 2, True, ts(10))], [(4, 1, 2, 1, True, ts(99))]]
    write_batches(spark, src, parts)
    start = ledger.start_leaderboard(stream(spark, src), teams, challenges, *paths, 4, parts=16)
    run(start)
    of = as_dict(teams.select("id", buckets.bucket_of(["id"], 16).alias("b")), "id", "b")
    assert set(buckets.manifest(spark, f"{paths[1]}/solves")) == {of[1], of[2]}
    stands = buckets.manifest(spark, paths[2])
    assert stands[of[2]] == 1 and stands[of[1]] == (1 if of[1] == of[2] else 0) and {stands[of[3]], stands[of[4]]} <= {-1, 0, 1}
    board = ledger.latest_board(spark, paths[2], 4, "bigint")
    assert as_dict(board, "rank", "id", "score") == {1: (2, 30), 2: (1, 10), 3: (3, 0), 4: (4, 0)}


def test_buckets_keep_two_versions(spark, tmp_path):
    path, ddl = str(tmp_path / "store"), "k long, v string"
    buckets.rewrite(frame(spark, [(i, "a") for i in range(40)], ddl), path, ["k"], list(range(8)), 0, 8)
    hit = buckets.touched(frame(spark, [(3,), (4,)], "k long"), ["k"], 8)
    for version in (1, 2, 3):
        rows = buckets.read(spark, path, ddl, hit, version - 1).withColumn("v", F.lit(f"v{version}"))
        buckets.rewrite(rows, path, ["k"], hit, version, 8)
    now = as_dict(buckets.read(spark, path, ddl), "k", "v")
    assert set(now) == set(range(40)) and now[3] == now[4] == "v3" and set(now.values()) == {"a", "v3"}
    assert as_dict(buckets.read(spark, path, ddl, hit, upto=2), "k", "v")[3] == "v2"
    assert buckets._listed(spark, path, "version") == [0, 2, 3]
    buckets._drop(spark, f"{path}/version=3/{buckets.MARK}")  # as if its writer had failed
    assert as_dict(buckets.read(spark, path, ddl), "k", "v")[3] == "v2"
    buckets.rewrite(frame(spark, [], ddl), path, ["k"], hit, 3, 8)
    assert buckets.read(spark, path, ddl, hit).count() == 0 and buckets.read(spark, path, ddl, hit, upto=2).count() > 0
    assert buckets.read(spark, str(tmp_path / "none"), ddl).count() == 0


def test_a_request_delivered_twice_is_routed_once(spark, tmp_path):
    """In one micro-batch, in the next and after a restart; files that were read are archived."""
    body = json.dumps({"sql": {"__type": "user", "details": {"__query_name": "get_all", "params": {}}}})
    src, out, cp, old = (str(tmp_path / x) for x in ("in", "out", "cp", "old"))
    ddl = "request_id string, body string, received_at timestamp_ntz"

    def deliver(name, *requests):
        frame(spark, [(i, b, ts(at)) for i, b, at in requests], ddl).coalesce(1).write.json(f"{src}/{name}")

    def route():
        s = sources.read_requests(spark, f"{src}/*", per_trigger=1, archive=old)
        run(sources.start_routing(s, out, cp, received="received_at", within="1 minute"))

    deliver("a", ("1", body, 0), ("1", body, 1), ("2", "{", 2))
    deliver("b", ("2", "{", 20), ("3", body, 21))
    route()
    deliver("c", ("3", body, 25), ("4", body, 26), ("1", body, 27))
    route()
    got = [tuple(r) for r in spark.read.parquet(out).select("request_id", "target").orderBy("request_id").collect()]
    assert [g[0] for g in got] == ["1", "2", "3", "4"] and got[1][1] == "refused"
    # Nothing is lost: what is read stands in the archive or still in the source.
    held = [spark.read.option("recursiveFileLookup", True).schema(ddl).json(x).count() for x in (src, old)]
    assert sum(held) == 8 and held[1] > 0
    deliver("d", ("5", body, 30))
    assert as_set(envelope.read_requests(spark, f"{src}/d"), "request_id", "body") == {("5", body)}


def test_a_duplicate_later_than_the_bound_is_dropped_and_ids_without_one_are_kept_for_ever(spark, tmp_path):
    ddl = "request_id string, body string, received_at timestamp_ntz"
    src = str(tmp_path / "in")
    for i, part in enumerate([[("a", "x", ts(0))], [("b", "x", ts(9000))], [("d", "x", ts(9100))], [("a", "x", ts(9200)), ("c", "x", ts(5))]]):
        frame(spark, part, ddl).coalesce(1).write.json(f"{src}/{i}")
    got = {}
    for name, received in (("ever", None), ("bound", "received_at")):
        out = sources.once(sources.read_requests(spark, f"{src}/*", per_trigger=1), received, "1 minute")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp"))
        run(q.trigger(availableNow=True).start())
        got[name] = sorted(r[0] for r in spark.read.parquet(str(tmp_path / name)).select("request_id").collect())
    assert got == {"ever": ["a", "b", "c", "d"], "bound": ["a", "a", "b", "d"]}
