from __future__ import annotations

from helpers import as_dict, as_set, frame, ts

from solvelake.operators import quality


def test_duplicates_fold_case_and_skip_nulls(spark):
    u = frame(
        spark, [(1, "Ann", "a@x"), (2, "ANN", "b@x"), (3, None, "A@X"), (4, None, "c@x")],
        "id long, name string, email string",
    )
    assert as_set(quality.table_duplicates(u, "users"), "key", "value", "n") == {("name", "ann", 2), ("email", "a@x", 2)}
    f = frame(spark, [(1, "n1", "x"), (2, "n2", "X"), (3, "n3", "x")], "id long, name string, source_folder string")
    assert as_set(quality.table_duplicates(f, "challenges"), "key", "value", "n") == {("source_folder", "x", 2)}


def test_orphans(spark):
    users = frame(spark, [(1, 1), (2, 5), (3, None)], "id long, team_id long")
    teams = frame(spark, [(1,)], "id long")
    assert as_set(quality.orphans(users, "team_id", teams), "id") == {(2,)}
    assert as_dict(quality.all_orphans({"users": users, "teams": teams}), "child", "n") == {"users": 1}


def test_nulls_and_domains(spark):
    links = frame(
        spark, [(1, 1, None, "web"), (2, None, None, "ftp"), (3, 1, "u", None)],
        "id long, challenge_id long, url string, type string",
    )
    assert as_dict(quality.null_violations(links, "challenge_links"), "column", "n") == {
        "id": 0, "challenge_id": 1, "url": 2, "type": 1
    }
    assert as_dict(quality.domain_violations(links, "challenge_links"), "column", "n") == {"type": 1}
    c = frame(
        spark, [("f" * 256, ["a" * 256, "b"]), ("f" * 255, ["a" * 255])], "flag string, tags array<string>"
    )
    assert as_dict(quality.domain_violations(c, "challenges"), "column", "n") == {"flag": 1, "tags": 1}


def test_ledger_checks(spark):
    a = frame(
        spark, [(1, True, 1, 1, 1), (2, False, 1, 1, 2), (3, True, 2, 2, 1)],
        "id long, correct boolean, user_id long, team_id long, challenge_id long",
    )
    led = frame(
        spark,
        [(1, 1, 1, 1, ts(0)), (2, 1, 1, 2, ts(0)), (3, 9, 2, 1, ts(0)), (4, 1, 1, 1, ts(0))],
        "attempt_id long, user_id long, team_id long, challenge_id long, solved_at timestamp_ntz",
    )
    assert as_dict(quality.ledger_faults(led, a), "attempt_id", "fault") == {
        2: "not_correct", 3: "other_user_id", 4: "no_attempt"
    }
    c = frame(spark, [(1, 10, 3), (2, 20, 0)], "id long, points int, solve_count int")
    t = frame(spark, [(1, 40), (2, 0), (3, 5)], "id long, score int")
    assert as_set(quality.score_drift(t, led, c, "team_id"), "id", "stored", "derived") == {(2, 0, 10), (3, 5, 0)}
    assert as_set(quality.count_drift(c, led), "id", "stored", "derived") == {(2, 0, 1)}
