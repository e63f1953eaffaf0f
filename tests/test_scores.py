from __future__ import annotations

import random

import pytest
from helpers import as_dict, as_list, frame, ts

from solvelake.operators import leaderboard, refresh, scores

LEDGER = "attempt_id long, user_id long, challenge_id long, team_id long, solved_at timestamp_ntz"
CHALL = "id long, points int, solve_count int, updated_at timestamp_ntz"
TEAM = "id long, name string, score long, last_solve timestamp_ntz, eligible boolean, affiliation string, " \
    "inserted_at timestamp_ntz, updated_at timestamp_ntz"


@pytest.fixture(scope="module")
def challenges(spark):
    return frame(spark, [(i, 10 * i, 0, ts(0)) for i in range(1, 40)], CHALL)


def team(id_, score, last, born=0):
    return (id_, f"t{id_}", score, None if last is None else ts(last), True, None, ts(born), ts(born))


def test_scores_with_zero_teams_and_moved_user(spark, challenges):
    led = frame(spark, [(1, 7, 1, 1, ts(5)), (2, 7, 2, 2, ts(9)), (3, 8, 3, 1, ts(7))], LEDGER)
    owners = frame(spark, [(1,), (2,), (3,)], "id long")
    assert as_dict(scores.team_scores(owners, led, challenges), "team_id", "score", "last_solve") == {
        1: (40, ts(7)),
        2: (20, ts(9)),
        3: (0, None),
    }
    # User 7 solved for two teams; the user keeps both.
    users = frame(spark, [(7,), (8,), (9,)], "id long")
    assert as_dict(scores.user_scores(users, led, challenges), "user_id", "score") == {7: 30, 8: 30, 9: 0}
    counts = as_dict(scores.solve_counts(challenges, led), "challenge_id", "solve_count")
    assert counts[1] == 1 and counts[5] == 0


def test_history_ties_and_start(spark, challenges):
    led = frame(
        spark,
        [
            (1, 1, 1, 1, ts(0)),  # 10, before start
            (2, 1, 2, 1, ts(100)),  # 20, at start
            (3, 1, 3, 1, ts(100)),  # 30, same second
            (4, 1, 4, 1, ts(101)),  # 40
            (5, 1, 5, 2, ts(99)),
        ],
        LEDGER,
    )
    start = str(ts(100))
    assert as_list(scores.score_history(led, challenges, start), "team_id", "score", "time") == [
        (1, 100, ts(101)),
        (1, 30, ts(100)),
        (1, 40, ts(100)),
    ]
    ids = frame(spark, [(1,), (2,), (3,)], "team_id long")
    got = as_dict(scores.initial_scores(ids, led, challenges, start), "team_id", "score", "time")
    assert got == {1: (10, ts(100)), 2: (50, ts(100)), 3: (0, ts(100))}


def brute(led, points, team_id, at):
    return sum(points[c] for _, _, c, t, when in led if t == team_id and when < at)


@pytest.mark.parametrize("span", [30, 20000, 4000000])
def test_running_totals_equal_brute_force(spark, challenges, span):
    """Spans inside one hour slice, over some and over many; one team holds most solves."""
    rng = random.Random(span)
    points = {i: 10 * i for i in range(1, 40)}
    led = [
        (i, 1, rng.randrange(1, 40), rng.choice([1, 1, 1, 2, 3]), ts(rng.randrange(-span // 3, span)))
        for i in range(300)
    ]
    df = frame(spark, led, LEDGER)
    start = ts(span // 4)
    want = sorted(
        ((t, brute(led, points, t, at) + points[c], at) for _, _, c, t, at in led if at >= start), key=repr
    )
    assert as_list(scores.score_history(df, challenges, str(start)), "team_id", "score", "time") == want
    probes = [(i, rng.choice([1, 2, 3, 4]), ts(rng.randrange(-span, 2 * span))) for i in range(200)]
    got = as_dict(
        scores.score_at(frame(spark, probes, "id long, team_id long, at timestamp_ntz"), df, challenges), "id", "score"
    )
    assert got == {i: brute(led, points, t, at) for i, t, at in probes}


def test_top_teams_order(spark):
    t = frame(
        spark,
        [
            team(1, 50, None),  # equal score without a solve time comes last
            team(2, 50, 20),
            team(3, 50, 10, born=5),
            team(4, 50, 10, born=4),
            team(6, 70, 99),
            team(5, 50, 10, born=4),
            team(7, 0, None),
        ],
        TEAM,
    )
    top = leaderboard.top_teams(t, 100)
    assert [r.id for r in top.orderBy("rank").collect()] == [6, 4, 5, 3, 2, 1, 7]
    assert [r.id for r in leaderboard.top_team_details(t, 2).orderBy("rank").collect()] == [6, 4]
    assert leaderboard.top_teams(t, 0).count() == 0
    for bad in (101, -1):
        with pytest.raises(ValueError):
            leaderboard.top_teams(t, bad)


def test_top_history_keeps_only_top(spark, challenges):
    led = frame(spark, [(1, 1, 5, 1, ts(10)), (2, 1, 4, 2, ts(10)), (3, 1, 1, 2, ts(20))], LEDGER)
    t = frame(spark, [team(1, 50, 10), team(2, 50, 20), team(3, 0, None)], TEAM)
    out = leaderboard.top_teams_history(t, led, challenges, 1, str(ts(10)))
    assert as_list(out, "team_id", "score", "time") == [(1, 0, ts(10)), (1, 50, ts(10))]


def test_refresh_touches_only_changed_owners(spark, challenges):
    led = frame(spark, [(1, 1, 1, 1, ts(1)), (2, 1, 2, 1, ts(2)), (3, 1, 3, 2, ts(3))], LEDGER)
    fresh = led.where("attempt_id = 2")
    t = frame(spark, [team(1, 10, 1), team(2, 999, 3)], TEAM)
    now = str(ts(500))
    got = as_dict(refresh.refresh_owners(t, led, challenges, fresh, "team_id", now), "id", "score", "last_solve")
    assert got == {1: (30, ts(500)), 2: (999, ts(3))}
    c = refresh.refresh_challenges(challenges, led, fresh, now).where("id < 4")
    assert as_dict(c, "id", "solve_count", "updated_at") == {1: (0, ts(0)), 2: (1, ts(500)), 3: (0, ts(0))}
    # A full recompute repairs every score and leaves the times alone.
    got = as_dict(refresh.recompute_owners(t, led, challenges, "team_id"), "id", "score", "last_solve")
    assert got == {1: (30, ts(1)), 2: (30, ts(3))}
    assert refresh.recompute_owners(t, led, challenges, "team_id").schema["score"].dataType == t.schema["score"].dataType
