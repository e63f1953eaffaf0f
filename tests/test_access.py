from __future__ import annotations

import random

from helpers import as_dict, frame

from solvelake.operators import access, passes

USERS = "id long, team_id long, admin boolean"
CREDS = "user_id long, provider_name string, sub string"


def test_membership_and_admission(spark):
    users = frame(spark, [(1, 10, False), (2, None, False)], USERS)
    challenges = frame(spark, [(5,)], "id long")
    claims = frame(
        spark,
        [
            (1, 1, 10, 5, True),
            (2, 1, 11, 5, True),
            (3, 2, 10, 5, True),  # teamless
            (4, 9, 10, 5, True),
            (5, 1, 10, 5, False),
            (6, 1, 10, 6, True),
            (7, 1, 11, 6, False),  # several faults: the first check names it
            (8, 1, 10, 5, None),
        ],
        "id long, user_id long, team_id long, challenge_id long, auth_ok boolean",
    )
    assert as_dict(access.admit(claims, users, challenges), "id", "outcome") == {
        1: "accepted",
        2: "not_on_team",
        3: "not_on_team",
        4: "does_not_exist",
        5: "bad_auth",
        6: "unknown_challenge",
        7: "not_on_team",
        8: "bad_auth",
    }


def test_signin(spark):
    creds = frame(spark, [(1, "a", "s"), (1, "b", "t"), (2, None, "s")], CREDS)
    asks = frame(
        spark,
        [(1, 1, "s", "a"), (2, 1, "s", "b"), (3, 1, "t", "b"), (4, 2, "s", "a"), (5, 3, "s", "a")],
        "id long, user_id long, sub string, provider string",
    )
    assert as_dict(access.signin_outcomes(asks, creds), "id", "outcome") == {
        1: "authenticated",
        2: "bad_auth",
        3: "authenticated",
        4: "bad_auth",
        5: "not_found",
    }
    assert as_dict(access.oauth_matches(asks, creds), "id", "matches") == {1: True, 2: False, 3: True, 4: False, 5: False}


def sequential(commands, users):
    known, admins, out = {u[0] for u in users}, {u[0] for u in users if u[2]}, {}
    for seq, actor, target, ok in sorted(commands):
        if not ok:
            out[seq] = "auth"
        elif actor not in known:
            out[seq] = "does_not_exist"
        elif actor not in admins:
            out[seq] = "auth"
        elif target not in known:
            out[seq] = "does_not_exist"
        else:
            out[seq] = "promoted"
            admins.add(target)
    return out


def test_promotions_equal_one_at_a_time(spark):
    rng = random.Random(3)
    users = [(i, None, i == 0) for i in range(30)]
    # A chain through the batch, then noise.
    commands = [(i, i, i + 1, True) for i in range(12)]
    commands += [(100 + i, rng.randrange(35), rng.randrange(35), rng.random() < 0.8) for i in range(150)]
    got = access.promotions(
        frame(spark, commands, "seq long, admin_id long, target_id long, auth_ok boolean"), frame(spark, users, USERS)
    )
    assert as_dict(got, "seq", "outcome") == sequential(commands, users)


def test_promotion_before_rights_fails(spark):
    users = [(0, None, True), (1, None, False), (2, None, False)]
    commands = [(1, 1, 2, True), (2, 0, 1, True), (3, 1, 2, True)]
    got = access.promotions(
        frame(spark, commands, "seq long, admin_id long, target_id long, auth_ok boolean"), frame(spark, users, USERS)
    )
    assert as_dict(got, "seq", "outcome") == {1: "auth", 2: "promoted", 3: "promoted"}


PROMOTE = "seq long, admin_id long, target_id long, auth_ok boolean"


def test_long_promotion_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of a thousand, half of it out of order, with commands that no admin ever backs."""
    cuts, real = [], passes.cut
    for m in (access, passes):
        monkeypatch.setattr(m, "cut", lambda df: cuts.append(1) or real(df))
    users = [(i, None, i == 0) for i in range(1200)]
    commands = [(i, i, i + 1, True) for i in range(1000)]
    commands += [(5000 - i, 1100 + i, 1101 + i, True) for i in range(50)]
    got = access.promotions(frame(spark, commands, PROMOTE), frame(spark, users, USERS))
    assert as_dict(got, "seq", "outcome") == sequential(commands, users)
    assert len(cuts) <= 60


def test_large_promotion_groups_and_places(spark, monkeypatch):
    monkeypatch.setattr(passes, "GROUP", 3)
    users = [(i, None, i == 0) for i in range(40)]
    rng = random.Random(5)
    commands = [(i, i, i + 1, True) for i in range(9)] + [(100 + i, rng.randrange(40), rng.randrange(40), True) for i in range(60)]
    got = access.promotions(frame(spark, [*commands, (None, 0, 39, True)], PROMOTE), frame(spark, users, USERS))
    assert as_dict(got.where("seq is not null"), "seq", "outcome") == sequential(commands, users)
    assert [r["outcome"] for r in got.where("seq is null").collect()] == ["missing_seq"]
    # Two commands of one place apply one after the other: either order gives one or two promotions of a chain.
    pair = access.promotions(frame(spark, [(1, 0, 1, True), (1, 1, 2, True)], PROMOTE), frame(spark, users, USERS))
    assert as_dict(pair, "target_id", "outcome")[1] == "promoted"
