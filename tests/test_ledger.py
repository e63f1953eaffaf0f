from __future__ import annotations

import random

import pytest
from helpers import as_dict, as_set, frame, ts

from solvelake.operators import ledger

ATTEMPT = "id long, user_id long, team_id long, challenge_id long, flag_guess string, inserted_at timestamp_ntz"
CHALL = "id long, name string, flag string, points int"


@pytest.fixture(scope="module")
def challenges(spark):
    return frame(spark, [(1, "one", "F1", 100), (2, "two", "f2", 50)], CHALL)


def test_flags_are_exact_and_unknown_challenges_undecided(spark, challenges):
    a = frame(
        spark,
        [(1, 1, 1, 1, "F1", ts(0)), (2, 1, 1, 1, "f1", ts(1)), (3, 1, 1, 9, "F1", ts(2))],
        ATTEMPT,
    )
    assert as_dict(ledger.check_guesses(a, challenges), "id", "correct") == {1: True, 2: False, 3: None}


def test_first_correct_ties_and_teams(spark, challenges):
    a = frame(
        spark,
        [
            (5, 1, 1, 1, "F1", ts(10)),
            (4, 2, 1, 1, "F1", ts(10)),  # same second, smaller id wins
            (6, 3, 2, 1, "F1", ts(11)),  # another team counts too
            (7, 3, 2, 1, "F1", ts(12)),  # its second one does not
            (8, 1, 1, 2, "F2", ts(0)),  # wrong case
        ],
        ATTEMPT,
    )
    out = ledger.adjudicate(a, challenges)
    assert as_dict(out, "id", "correct", "already_solved", "counted") == {
        4: (True, False, True),
        5: (True, True, False),
        6: (True, False, True),
        7: (True, True, False),
        8: (False, False, False),
    }
    assert as_set(ledger.first_correct(out), "attempt_id", "user_id", "solved_at") == {(4, 2, ts(10)), (6, 3, ts(11))}


def test_existing_ledger_wins_even_if_later(spark, challenges):
    old = frame(
        spark,
        [(99, 9, 1, 1, ts(1000))],
        "attempt_id long, user_id long, challenge_id long, team_id long, solved_at timestamp_ntz",
    )
    a = frame(spark, [(1, 1, 1, 1, "F1", ts(0)), (2, 1, 2, 1, "F1", ts(5))], ATTEMPT)
    out = ledger.adjudicate(a, challenges, old)
    assert as_dict(out, "id", "already_solved", "counted") == {1: (True, False), 2: (False, True)}
    fresh = ledger.new_successes(ledger.check_guesses(a, challenges), old)
    assert as_set(fresh, "attempt_id") == {(2,)}


def test_batch_equals_one_at_a_time(spark, challenges):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        c = rng.choice([1, 1, 1, 2])
        guess = rng.choice(["F1", "f2", "no"])
        rows.append((i, rng.randrange(5), rng.choice([1, 1, 2, 3]), c, guess, ts(rng.randrange(60))))
    want, solved = {}, set()
    flags = {1: "F1", 2: "f2"}
    for id_, _, team, chall, guess, _ in sorted(rows, key=lambda r: (r[5], r[0])):
        right = guess == flags[chall]
        done = (chall, team) in solved
        want[id_] = (right, done, right and not done)
        if right:
            solved.add((chall, team))
    out = ledger.adjudicate(frame(spark, rows, ATTEMPT), challenges)
    assert as_dict(out, "id", "correct", "already_solved", "counted") == want


def test_solves_flag_and_semi_join(spark, challenges):
    a = ledger.check_guesses(
        frame(spark, [(1, 1, 1, 1, "F1", ts(0)), (2, 1, 2, 1, "no", ts(1))], ATTEMPT), challenges
    )
    s = ledger.solves(a, ledger.first_correct(a))
    assert as_dict(s, "id", "counted") == {1: True, 2: False}
    ids = frame(spark, [(1,), (1,)], "team long")
    assert [r.id for r in ledger.solves_of(s, ids, "team_id").collect()] == [1]


def test_first_blood_details(spark, challenges):
    teams = frame(spark, [(1, "reds"), (2, "blues")], "id long, name string")
    users = frame(spark, [(1, "ann"), (2, "bob")], "id long, name string")
    a = ledger.check_guesses(
        frame(
            spark,
            [(1, 1, 1, 1, "no", ts(0)), (3, 1, 1, 1, "F1", ts(5)), (2, 2, 2, 1, "F1", ts(5)), (4, 1, 1, 2, "x", ts(1))],
            ATTEMPT,
        ),
        challenges,
    )
    out = ledger.first_blood_details(a, challenges, teams, users)
    assert as_set(out, "attempt_id", "chall", "team", "user") == {(2, "one", "blues", "bob")}
    assert as_dict(ledger.is_first_blood(a), "id", "is_first_blood") == {1: False, 2: True, 3: False, 4: False}


def test_empty_log(spark, challenges):
    a = frame(spark, [], ATTEMPT)
    assert ledger.adjudicate(a, challenges).count() == 0
    assert ledger.first_correct(ledger.check_guesses(a, challenges)).count() == 0
