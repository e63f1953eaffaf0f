from __future__ import annotations

import random

from helpers import as_dict, as_set, frame, ts
from pyspark.sql import functions as F

from solvelake.operators import attempts, ledger, scores
from solvelake.sources import buckets

NOW = str(ts(900))


def test_batch_from_claim_to_tables(spark):
    stored = "score int, last_solve timestamp_ntz, updated_at timestamp_ntz"
    users = frame(
        spark, [(1, "ann", 1, 10, ts(1), ts(0)), (2, "bob", 2, 0, None, ts(0)), (3, "cy", None, 0, None, ts(0))],
        f"id long, name string, team_id long, {stored}",
    )
    teams = frame(
        spark, [(1, "reds", 10, ts(1), ts(0)), (2, "blues", 0, None, ts(0))], f"id long, name string, {stored}"
    )
    challenges = frame(
        spark, [(1, "one", "F", 10, 1, ts(0)), (2, "two", "G", 20, 0, ts(0))],
        "id long, name string, flag string, points int, solve_count int, updated_at timestamp_ntz",
    )
    creds = frame(spark, [(i, "p", f"s{i}") for i in (1, 2, 3)], "user_id long, provider_name string, sub string")
    log = frame(
        spark, [(1, 1, 1, 1, True, ts(1))],
        "id long, user_id long, team_id long, challenge_id long, correct boolean, inserted_at timestamp_ntz",
    )
    claims = frame(
        spark,
        [
            (10, 1, 1, 1, "F", ts(100), "s1", "p"),  # solved before
            (11, 2, 2, 1, "F", ts(101), "s2", "p"),  # counts, but no first blood
            (12, 2, 2, 2, "g", ts(102), "s2", "p"),  # wrong
            (13, 1, 1, 2, "G", ts(103), "s1", "p"),  # first blood
            (14, 2, 2, 2, "G", ts(104), "s2", "p"),  # counts
            (15, 3, 1, 2, "G", ts(90), "s3", "p"),  # teamless
            (16, 1, 1, 2, "G", ts(91), "s2", "p"),  # wrong credential
            (17, 1, 1, 7, "G", ts(92), "s1", "p"),  # no such challenge
        ],
        "id long, user_id long, team_id long, challenge_id long, flag_guess string, inserted_at timestamp_ntz, "
        "sub string, provider string",
    )
    out = attempts.process(claims, creds, users, teams, challenges, log, ledger.first_correct(log), NOW)
    assert as_dict(out.judged.where("outcome <> 'accepted'"), "id", "outcome") == {
        15: "not_on_team", 16: "bad_auth", 17: "unknown_challenge"
    }
    assert as_dict(out.attempts, "id", "correct", "already_solved", "counted") == {
        10: (True, True, False),
        11: (True, False, True),
        12: (False, False, False),
        13: (True, False, True),
        14: (True, False, True),
    }
    assert as_set(out.successes, "attempt_id") == {(11,), (13,), (14,)}
    assert as_dict(out.teams, "id", "score", "last_solve") == {1: (30, ts(900)), 2: (30, ts(900))}
    assert as_dict(out.users, "id", "score", "updated_at") == {1: (30, ts(900)), 2: (30, ts(900)), 3: (0, ts(0))}
    assert as_dict(out.challenges, "id", "solve_count") == {1: 2, 2: 2}
    assert as_set(out.bloods, "attempt_id", "chall", "team", "user") == {(13, "two", "reds", "ann")}


def test_stored_ledger_equals_the_whole_over_batches(spark, tmp_path):
    """Batches against buckets give what batches against the whole ledger give, and write what they touch only."""
    rng = random.Random(4)
    stored = "score int, last_solve timestamp_ntz, updated_at timestamp_ntz"
    users = frame(spark, [(i, f"u{i}", i % 5, 0, None, ts(0)) for i in range(20)], f"id long, name string, team_id long, {stored}")
    teams = frame(spark, [(i, f"t{i}", 0, None, ts(0)) for i in range(5)], f"id long, name string, {stored}")
    challenges = frame(
        spark, [(i, f"c{i}", "F", 10 + i, 0, ts(0)) for i in range(6)],
        "id long, name string, flag string, points int, solve_count int, updated_at timestamp_ntz",
    )
    creds = frame(spark, [(i, "p", f"s{i}") for i in range(20)], "user_id long, provider_name string, sub string")
    log = frame(
        spark, [(1, 1, 1, 1, True, ts(1)), (2, 2, 2, 1, False, ts(2)), (3, 3, 3, 2, True, ts(3))],
        "id long, user_id long, team_id long, challenge_id long, correct boolean, inserted_at timestamp_ntz",
    )
    led = ledger.first_correct(log)
    path = str(tmp_path / "store")
    attempts.store_ledger(log, led, path, 16)
    ddl = "id long, user_id long, team_id long, challenge_id long, flag_guess string, inserted_at timestamp_ntz, sub string, provider string"
    for version in (1, 2):
        rows = []
        for i in range(12):
            u = rng.randrange(20)
            rows.append((100 * version + i, u, u % 5, rng.randrange(4 + version), rng.choice("FFG"), ts(100 * version + i), f"s{u}", "p"))
        claims = frame(spark, rows, ddl)
        whole = attempts.process(claims, creds, users, teams, challenges, log, led, NOW)
        part = attempts.process_stored(claims, creds, users, teams, challenges, path, version, NOW, parts=16)
        assert as_set(part.attempts, "id", "correct", "already_solved", "counted") == as_set(whole.attempts, "id", "correct", "already_solved", "counted")
        assert as_set(part.bloods, "attempt_id", "chall", "team", "user") == as_set(whole.bloods, "attempt_id", "chall", "team", "user")
        for table in ("users", "teams"):
            assert as_set(getattr(part, table), "id", "score", "last_solve") == as_set(getattr(whole, table), "id", "score", "last_solve")
        assert as_set(part.challenges, "id", "solve_count") == as_set(whole.challenges, "id", "solve_count")
        led = led.unionByName(whole.successes.select(*led.columns))
        log = log.unionByName(whole.attempts.select(*log.columns))
        for key in attempts.STORED:
            held = buckets.read(spark, f"{path}/{key}", led.schema)
            assert as_set(held, *attempts.SOLVE) == as_set(led, *attempts.SOLVE)
            changed = buckets.touched(part.successes, [key], 16)
            assert {k for k, v in buckets.manifest(spark, f"{path}/{key}").items() if v == version} == set(changed)


def test_a_batch_opens_its_buckets_only(spark, tmp_path):
    rows = frame(spark, [(i, i, i, i, ts(i)) for i in range(400)], "attempt_id long, user_id long, challenge_id long, team_id long, solved_at timestamp_ntz")
    path = str(tmp_path / "store")
    buckets.rewrite(rows, path, ["team_id"], list(range(32)), 0, 32)
    claims = frame(spark, [(7,), (9,)], "team_id long")
    hit = buckets.touched(claims, ["team_id"], 32)
    part = buckets.read(spark, path, rows.schema, hit)
    assert len(part.inputFiles()) == len(hit) <= 2 and len(buckets.read(spark, path, rows.schema).inputFiles()) > 20
    assert {7, 9} <= {r[0] for r in part.select("team_id").collect()}


def test_scores_at_instants_open_the_probed_teams_only(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, i, rng.randrange(8), rng.randrange(30), ts(rng.randrange(9000))) for i in range(200)]
    led = frame(spark, rows, "attempt_id long, user_id long, challenge_id long, team_id long, solved_at timestamp_ntz")
    challenges = frame(spark, [(i, 10 + i) for i in range(8)], "id long, points int")
    path = str(tmp_path / "store")
    attempts.store_ledger(led.withColumn("correct", F.lit(True)), led, path, 32)
    probes = frame(spark, [(1, 3, ts(5000)), (2, 3, ts(0)), (3, 9, ts(8999)), (4, 77, ts(5))], "id long, team_id long, at timestamp_ntz")
    got = scores.score_at_stored(probes, path, challenges, parts=32)
    assert as_dict(got, "id", "score") == as_dict(scores.score_at(probes, led, challenges), "id", "score")
    assert sum("team_id" in f for f in got.inputFiles()) <= 3
