from __future__ import annotations

import random

import pytest
from helpers import as_dict, as_list, as_set, frame, ts
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from solvelake.operators import creation, credentials, ledger, passes, patches, quality, refresh, removal, upserts

NOW, OLD = str(ts(500)), ts(0)
USER = "id long, name string, email string, team_id long, eligible boolean, admin boolean, score int, " \
    "last_solve timestamp_ntz, inserted_at timestamp_ntz, updated_at timestamp_ntz"
TEAM = "id long, name string, description string, eligible boolean, affiliation string, score int, " \
    "last_solve timestamp_ntz, inserted_at timestamp_ntz, updated_at timestamp_ntz"


def user(id_, team=None, name=None):
    return (id_, name or f"User{id_}", f"u{id_}@x", team, False, False, 0, None, OLD, OLD)


def team(id_, name=None, affiliation=None):
    return (id_, name or f"Team{id_}", "d", True, affiliation, 0, None, OLD, OLD)


def test_user_patches_equal_one_at_a_time(spark):
    rng = random.Random(1)
    users = [user(i) for i in range(8)]
    want = {u[0]: [u[1], u[4], u[5], u[9]] for u in users}
    rows = []
    for seq in range(120):
        uid = rng.choice([0, 0, 0, 1, 2, 3, 4, 99])
        rows.append((
            seq, uid, rng.choice([None, f"n{seq}"]), rng.choice([None, True, False]), rng.choice([None, True, False])
        ))
    for _, uid, name, eligible, admin in rows:
        if uid in want:
            row = want[uid]
            row[0] = row[0] if name is None else name
            row[1] = row[1] if eligible is None else eligible
            row[2] = row[2] if admin is None else admin
            row[3] = ts(500)
    rng.shuffle(rows)
    p = frame(spark, rows, "seq long, user_id long, name string, eligible boolean, admin boolean")
    out = patches.patch_users(frame(spark, users, USER), p, NOW)
    assert as_dict(out, "id", "name", "eligible", "admin", "updated_at") == {k: tuple(v) for k, v in want.items()}
    affected = as_dict(patches.patch_outcomes(p, frame(spark, users, USER), "user_id"), "seq", "affected")
    assert affected == {seq: int(uid != 99) for seq, uid, *_ in rows}


def test_tri_state(spark):
    t = frame(spark, [team(1, affiliation="a"), team(2, affiliation="b"), team(3, affiliation="c"), team(4)], TEAM)
    none = (None, None, None)
    p = frame(
        spark,
        [
            (1, 1, *none, True, "new"),
            (2, 1, *none, False, "ignored"),
            (3, 2, *none, True, "x"),
            (4, 2, *none, True, None),  # cleared
            (5, 3, "renamed", None, False, False, None),
            (6, 4, *none, True, "late"),
        ],
        "seq long, team_id long, name string, description string, eligible boolean, has_affiliation boolean, "
        "affiliation string",
    )
    out = patches.patch_teams(t, p)
    assert as_dict(out, "id", "name", "eligible", "affiliation", "updated_at") == {
        1: ("Team1", True, "new", OLD),
        2: ("Team2", True, None, OLD),
        3: ("renamed", False, "c", OLD),
        4: ("Team4", True, "late", OLD),
    }


def test_join_team(spark):
    users = frame(spark, [user(1), user(2, 20), user(3)], USER)
    teams = frame(spark, [team(10, "Reds"), team(20, "Blues")], TEAM)
    c = frame(
        spark,
        [(1, 1, "REDS", True), (2, 1, "blues", True), (3, 1, "reds", False), (4, 2, "nope", True), (5, 9, "reds", True)],
        "seq long, user_id long, team_name string, auth_ok boolean",
    )
    out, judged = patches.join_team(users, teams, c, NOW)
    assert as_dict(out, "id", "team_id", "updated_at") == {1: (20, ts(500)), 2: (20, OLD), 3: (None, OLD)}
    assert as_dict(judged, "seq", "outcome") == {
        1: "joined", 2: "joined", 3: "auth", 4: "name_does_not_exist", 5: "does_not_exist"
    }


def sequential_teams(teams, users, commands):
    names = {t[1].lower() for t in teams}
    on_team = {u[0]: u[3] is not None for u in users}
    out = {}
    for seq, name, founder, ok in sorted(commands):
        if name.lower() in names:
            out[seq] = "name_taken"
        elif founder not in on_team:
            out[seq] = "does_not_exist"
        elif on_team[founder]:
            out[seq] = "already_on_team"
        elif not ok:
            out[seq] = "auth"
        else:
            out[seq] = "created"
            names.add(name.lower())
            on_team[founder] = True
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_create_teams_equal_one_at_a_time(spark, seed):
    rng = random.Random(seed)
    teams = [team(1, "Reds")]
    users = [user(i, 1 if i == 0 else None) for i in range(12)]
    commands = [
        (seq, rng.choice(["Reds", "a", "A", "b", "c", "C", "d", "e"]), rng.randrange(14), rng.random() < 0.8)
        for seq in range(40)
    ]
    # Each waits for the one before: (n0, f0), (n0, f1), (n1, f1), (n1, f2) ...
    if seed == 2:
        commands = [(i, f"n{i // 2}", (i + 1) // 2, True) for i in range(12)]
    c = frame(spark, commands, "seq long, name string, founder_id long, auth_ok boolean").withColumns(
        {"description": F.lit(""), "eligible": F.lit(True), "affiliation": F.lit(None).cast("string")}
    )
    out, moved, judged = creation.create_teams(
        frame(spark, teams, TEAM), frame(spark, users, USER), c, NOW, 1000 + F.col("seq")
    )
    want = sequential_teams(teams, users, commands)
    assert as_dict(judged, "seq", "outcome") == want
    made = {seq for seq, o in want.items() if o == "created"}
    assert as_set(out, "id") == {(1,)} | {(1000 + s,) for s in made}
    founders = {c[2]: 1000 + c[0] for c in commands if c[0] in made}
    assert as_dict(moved, "id", "team_id") == {u[0]: founders.get(u[0], u[3]) for u in users}
    assert as_set(out.where("id > 999"), "score", "last_solve", "inserted_at") <= {(0, None, ts(500))}
    quality.require_unique(out, "teams")


def test_create_users_equal_one_at_a_time(spark):
    rng = random.Random(5)
    users = [user(1, name="Ann")]
    rows = [
        (seq, rng.choice(["ann", "Bob", "bob", "cy", "di", "ed"]), rng.choice(["u1@X", "a@x", "A@x", "b@x", "c@x"]))
        for seq in range(40)
    ]
    names, emails, want = {"ann"}, {"u1@x"}, {}
    for seq, name, email in rows:
        if name.lower() in names:
            want[seq] = "name_taken"
        elif email.lower() in emails:
            want[seq] = "email_taken"
        else:
            want[seq] = "created"
            names.add(name.lower())
            emails.add(email.lower())
    c = frame(spark, rows, "seq long, name string, email string").withColumns(
        {"eligible": F.lit(True), "admin": F.lit(False), "sub": F.col("name"), "provider": F.lit("p")}
    )
    creds = frame(spark, [], "user_id long, provider_name string, sub string")
    out, stored, judged = creation.create_users(frame(spark, users, USER), creds, c, NOW, 1000 + F.col("seq"))
    assert as_dict(judged, "seq", "outcome") == want
    made = {1000 + s for s, o in want.items() if o == "created"}
    assert {r.id for r in out.collect()} == made | {1}
    assert {r.user_id for r in stored.collect()} == made


def test_credentials_equal_one_at_a_time(spark):
    rng = random.Random(9)
    creds = {(u, "p"): "s0" for u in range(4)}
    rows, want = [], {}
    state = dict(creds)
    for seq in range(60):
        # User 0 gets most of the commands.
        row = (
            seq, rng.choice([0, 0, 0, 1, 2, 5]), rng.choice("ppq"), f"s{rng.randrange(3)}", rng.choice("pqr"),
            f"s{rng.randrange(3)}",
        )
        rows.append(row)
        _, u, old_p, old_s, new_p, new_s = row
        if state.get((u, old_p)) == old_s:
            state[(u, new_p)] = new_s
            want[seq] = "stored"
        else:
            want[seq] = "auth"
    rng.shuffle(rows)
    now, judged = credentials.update_credentials(
        frame(spark, [(u, p, s) for (u, p), s in creds.items()], "user_id long, provider_name string, sub string"),
        frame(
            spark, rows,
            "seq long, user_id long, old_provider string, old_sub string, new_provider string, new_sub string",
        ),
    )
    assert as_dict(judged, "seq", "outcome") == want
    assert as_set(now, "user_id", "provider_name", "sub") == {(u, p, s) for (u, p), s in state.items()}


def test_credentials_long_chain(spark, monkeypatch):
    """1,000 commands of one user who keeps the provider: few rounds, and the other columns stay."""
    cuts = []
    real = credentials.cut
    monkeypatch.setattr(credentials, "cut", lambda df: cuts.append(1) or real(df))
    rows = [(i, 1, "p", f"s{i}", "p", f"s{i + 1}") for i in range(1000)]
    rows += [(2000 + i, 2, "p", "no", "p", "x") for i in range(5)]
    ddl = "user_id long, provider_name string, sub string, id long, last_used timestamp_ntz, inserted_at timestamp_ntz, " \
        "updated_at timestamp_ntz"
    stored = frame(spark, [(1, "p", "s0", 10, ts(5), ts(0), ts(0)), (2, "p", "t", 11, None, ts(0), ts(0))], ddl)
    now, judged = credentials.update_credentials(
        stored, frame(spark, rows, "seq long, user_id long, old_provider string, old_sub string, new_provider string, new_sub string"),
        NOW,
    )
    assert judged.where("outcome = 'stored'").count() == 1000 and judged.count() == 1005
    assert as_set(now, "id", "user_id", "sub", "last_used") == {(10, 1, "s1000", ts(5)), (11, 2, "t", None)}
    assert as_dict(now, "id", "updated_at") == {10: ts(500), 11: ts(0)}
    # Two writes a round for ten rounds, and a fixed number around them.
    assert len(cuts) <= 2 * 12 + 10


def test_new_provider_row(spark):
    stored = frame(spark, [(1, "p", "s", 10)], "user_id long, provider_name string, sub string, id long")
    ask = frame(
        spark, [(1, 1, "p", "s", "q", "z"), (2, 1, "q", "z", "p", "y"), (3, 1, "p", "s", "p", "w")],
        "seq long, user_id long, old_provider string, old_sub string, new_provider string, new_sub string",
    )
    now, judged = credentials.update_credentials(stored, ask, NOW, F.lit(77).cast("bigint"))
    assert as_dict(judged, "seq", "outcome") == {1: "stored", 2: "stored", 3: "auth"}
    assert as_set(now, "user_id", "provider_name", "sub", "id") == {(1, "p", "y", 10), (1, "q", "z", 77)}


def test_null_claims_end(spark):
    claims = placed(spark, [(1, None, "a"), (2, "x", None), (3, "x", "a"), (4, "x", "b")])
    assert seqs(creation.first_come(claims, "l", "r")) == [3]


def test_touch_without_an_instant(spark):
    """No instant means the clock, here as everywhere."""
    users = frame(spark, [user(1, name="Ann"), user(2, name="Bob")], USER)
    p = frame(spark, [(1, 2, "Bo", None, None)], "seq long, user_id long, name string, eligible boolean, admin boolean")
    stamps = as_dict(patches.patch_users(users, p, None), "id", "updated_at")
    assert stamps[2] > stamps[1]


CHALL = "id long, name string, description string, flag string, points int, authors array<string>, " \
    "hints array<string>, categories array<string>, tags array<string>, solve_count int, visible boolean, " \
    "source_folder string, inserted_at timestamp_ntz, updated_at timestamp_ntz"
LINK = "id string, challenge_id long, url string, type string"


def chall(id_, folder, points=10):
    return (id_, f"C{id_}", "d", "f", points, [], [], [], [], 7, True, folder, OLD, OLD)


def command(seq, id_, folder, points, links):
    return (seq, id_, folder, f"new{seq}", "d2", "f2", points, ["au"], [], [], [], False, links)


def test_upsert_and_links(spark):
    challenges = frame(spark, [chall(1, "a"), chall(2, "b"), chall(3, "c")], CHALL)
    links = frame(spark, [("l1", 1, "u1", "web"), ("l3", 3, "u3", "nc")], LINK)
    commands = frame(
        spark,
        [
            command(1, None, "a", 1, [("web", "x"), ("nc", "y")]),
            command(2, None, "a", 2, [("admin", "z"), ("nc", "z2")]),
            command(3, 77, "a", 3, [("web", "never")]),  # 1 has links: its id stays
            command(4, 88, "b", 4, []),  # 2 has none: takes the new id
            command(5, None, "b", 5, []),  # and keeps it
            command(6, None, "new", 6, [("static", "s"), ("static", "s2")]),
        ],
        "seq long, id long, source_folder string, name string, description string, flag string, points int, "
        "authors array<string>, hints array<string>, categories array<string>, tags array<string>, visible boolean, "
        "links array<struct<type:string,location:string>>",
    )
    out, lists, judged = upserts.upsert_challenges(challenges, commands, [links], NOW, F.lit(500).cast("long"))
    assert as_dict(judged, "seq", "outcome") == {
        1: "stored", 2: "stored", 3: "id_in_use", 4: "stored", 5: "stored", 6: "stored"
    }
    got = as_dict(out, "source_folder", "id", "name", "points", "flag", "visible", "solve_count", "inserted_at", "updated_at")
    assert got == {
        "a": (1, "new2", 2, "f2", False, 7, OLD, ts(500)),
        "b": (88, "new5", 5, "f2", False, 7, OLD, ts(500)),
        "c": (3, "C3", 10, "f", True, 7, OLD, OLD),
        "new": (500, "new6", 6, "f2", False, 0, ts(500), ts(500)),
    }
    after = upserts.replace_links(links, out, lists)
    assert as_set(after, "challenge_id", "url", "type") == {
        (1, "z", "admin"), (1, "z2", "nc"), (3, "u3", "nc"), (500, "s", "static"), (500, "s2", "static")
    }
    quality.require_unique(after, "challenge_links")


def test_upserts_of_one_seq_and_without_a_folder(spark):
    """Of equal places the greatest command stands, a rejected one never; commands without a folder are one challenge."""
    challenges = frame(spark, [chall(1, "a"), chall(2, "b")], CHALL)
    links = frame(spark, [("l1", 1, "u", "web")], LINK)
    commands = frame(
        spark,
        [command(5, None, "a", 1, []), command(5, 9, "a", 2, []), command(7, 70, "b", 3, []), command(7, 71, "b", 4, []),
         command(8, 30, None, 5, [("web", "w")]), command(9, None, None, 6, [("web", "x")]), command(None, 4, "b", 7, [])],
        "seq long, id long, source_folder string, name string, description string, flag string, points int, "
        "authors array<string>, hints array<string>, categories array<string>, tags array<string>, visible boolean, "
        "links array<struct<type:string,location:string>>",
    )
    made = F.lit(500).cast("long")
    out, lists, judged = upserts.upsert_challenges(challenges, commands, [links], NOW, made)
    assert as_list(judged, "seq", "id", "outcome") == sorted(
        [(5, None, "stored"), (5, 9, "id_in_use"), (7, 70, "stored"), (7, 71, "stored"), (8, 30, "stored"), (9, None, "stored"),
         (None, 4, "missing_seq")], key=repr)
    assert as_set(out, "id", "source_folder", "points") == {(1, "a", 1), (71, "b", 4), (30, None, 6)}
    kept = upserts.replace_links(links, out, lists)
    assert as_set(kept, "challenge_id", "url", "type") == {(30, "x", "web")}
    plain = upserts.upsert_challenges(challenges, commands, [links], NOW, made, stored=False)
    for a, b in zip((out, lists, judged), plain, strict=True):
        assert as_list(a, *a.columns) == as_list(b, *a.columns)


def test_repeated_ids_of_links_are_refused(spark):
    """Links without a url are told apart by their ids alone."""
    lists = frame(spark, [(1, [("web", None)]), (1, [("web", None)])], "challenge_id long, links array<struct<type:string,location:string>>")
    none, known = frame(spark, [], LINK), frame(spark, [(1,)], "id long")
    with pytest.raises(ValueError, match="id="):
        upserts.replace_links(none, known, lists)
    assert upserts.replace_links(none, known, lists, unique=False).count() == 2


def test_clashing_upserts_are_refused(spark):
    challenges = frame(spark, [chall(1, "a"), chall(2, "b")], CHALL)
    ddl = "seq long, id long, source_folder string, name string, description string, flag string, points int, " \
        "authors array<string>, hints array<string>, categories array<string>, tags array<string>, visible boolean, " \
        "links array<struct<type:string,location:string>>"
    none = frame(spark, [], LINK)
    same_id = frame(spark, [command(1, 2, "a", 1, [])], ddl)
    with pytest.raises(SparkRuntimeException, match="id=2"):
        upserts.upsert_challenges(challenges, same_id, [none], NOW)[0].collect()
    two_ids = frame(spark, [command(1, 9, "a", 1, []), command(2, 9, "z", 1, [])], ddl)
    with pytest.raises(SparkRuntimeException, match="id=9"):
        upserts.upsert_challenges(challenges, two_ids, [none], NOW)[0].collect()
    lists = frame(spark, [(1, [("web", "u"), ("nc", "u")])], "challenge_id long, links array<struct<type:string,location:string>>")
    with pytest.raises(ValueError, match="challenge_id,url=1,u"):
        upserts.replace_links(none, challenges, lists)


def test_link_lists_for_unknown_challenges(spark):
    links = frame(spark, [("l1", 1, "u1", "web")], LINK)
    arrays = frame(spark, [(1, ["n"], [], ["w"]), (9, ["n"], [], [])], "challenge_id long, nc array<string>, "
                   "admin array<string>, web array<string>")
    lists = arrays.select(
        "challenge_id",
        upserts.link_list(nc=F.col("nc"), admin=F.col("admin"), web=F.col("web")).alias("links"),
    )
    out = upserts.replace_links(links, frame(spark, [(1,)], "id long"), lists)
    assert as_set(out, "challenge_id", "url", "type") == {(1, "n", "nc"), (1, "w", "web")}


def test_clashing_rename_is_refused(spark):
    users = frame(spark, [user(1, name="Ann"), user(2, name="Bob")], USER)
    p = frame(spark, [(1, 2, "ANN", None, None)], "seq long, user_id long, name string, eligible boolean, admin boolean")
    with pytest.raises(SparkRuntimeException, match="name=ann"):
        patches.patch_users(users, p, NOW).collect()
    assert patches.patch_users(users, p, NOW, unique=False).count() == 2
    assert quality.require_unique(users, "users") is users


def test_keys_of_a_change(spark):
    """Swaps and moves are fine, clashes with rows that stay or among the written rows are not; other rows do not count."""
    users = frame(spark, [user(i, name=n) for i, n in enumerate(["Ann", "Bob", "Cy", "Cy"])], USER)
    ddl = "seq long, user_id long, name string, eligible boolean, admin boolean"

    def renamed(*names):
        rows = [(s, i, n, None, None) for s, (i, n) in enumerate(names)]
        return as_dict(patches.patch_users(users, frame(spark, rows, ddl), NOW), "id", "name")

    assert renamed((0, "Bob"), (1, "ann")) == {0: "Bob", 1: "ann", 2: "Cy", 3: "Cy"}
    assert renamed((0, "Zed"), (9, "Bob"))[0] == "Zed"
    for clash in ([(0, "bob")], [(0, "New"), (1, "NEW")], [(0, "x"), (1, "cy")], [(2, "CY")]):
        with pytest.raises(SparkRuntimeException, match="name="):
            renamed(*clash)


def test_patches_without_seq_or_of_one_seq(spark):
    users = frame(spark, [user(1, name="Ann"), user(2, name="Bob"), user(3, name="Cy")], USER)
    ddl = "seq long, user_id long, name string, eligible boolean, admin boolean"
    p = frame(spark, [(None, 1, "No", True, None), (7, 2, "Ba", None, None), (7, 2, "Bz", None, True), (7, 2, "Bk", None, False)], ddl)
    out = patches.patch_users(users, p, NOW)
    assert as_dict(out, "id", "name") == {1: "Ann", 2: "Bz", 3: "Cy"}
    assert as_dict(out, "id", "updated_at") == {1: OLD, 2: ts(500), 3: OLD}
    assert as_dict(out, "id", "admin")[2] is True
    got = [(r[0], r[2]) for r in patches.patch_outcomes(p, users, "user_id").orderBy("seq").collect()]
    assert got == [(None, 0), (7, 1), (7, 1), (7, 1)]


ATTEMPT = "id long, flag_guess string, correct boolean, user_id long, challenge_id long, team_id long, " \
    "inserted_at timestamp_ntz"


@pytest.fixture
def world(spark):
    a = frame(
        spark,
        [
            (1, "f", True, 1, 1, 1, ts(1)),
            (2, "f", True, 2, 1, 1, ts(2)),
            (3, "x", False, 2, 1, 2, ts(3)),
            (4, "f", True, 2, 2, 2, ts(4)),
        ],
        ATTEMPT,
    )
    archive = a.limit(0).withColumn("deleted_at", F.lit(OLD))
    return removal.Solves(a, ledger.first_correct(a), archive)


def owners(spark, ids, score):
    rows = [(i, score, ts(4), OLD) for i in ids]
    return frame(spark, rows, "id long, score int, last_solve timestamp_ntz, updated_at timestamp_ntz")


def test_delete_does_not_promote_the_next(spark, world):
    left = removal.delete_solves(world, frame(spark, [(1,), (99,)], "id long"), NOW)
    assert as_set(left.attempts, "id") == {(2,), (3,), (4,)}
    assert as_set(left.successes, "attempt_id") == {(4,)}
    assert as_set(left.archive, "id", "deleted_at") == {(1, ts(500))}
    assert as_set(ledger.first_correct(left.attempts), "attempt_id") == {(2,), (4,)}


def test_clear_twice(spark, world):
    c = frame(spark, [(1, 10, 9, OLD), (2, 20, 9, OLD)], "id long, points int, solve_count int, updated_at timestamp_ntz")
    teams, users = owners(spark, [1, 2], 99), owners(spark, [1, 2, 3], 99)
    first = removal.delete_solves(world, frame(spark, [(2,)], "id long"), OLD.isoformat(sep=" "))
    ids = frame(spark, [(1,)], "challenge_id long")
    once = removal.clear_challenges(first, users, teams, c, ids, NOW)
    assert as_set(once.solves.attempts, "id") == {(4,)}
    assert as_set(once.archived, "id") == {(1,), (2,), (3,)}
    # Scores follow, the times of the last solve do not.
    assert as_dict(once.teams, "id", "score", "last_solve") == {1: (0, ts(4)), 2: (20, ts(4))}
    assert as_dict(once.users, "id", "score") == {1: 0, 2: 20, 3: 0}
    assert as_dict(once.challenges, "id", "solve_count") == {1: 0, 2: 1}
    twice = removal.clear_challenges(once.solves, once.users, once.teams, once.challenges, ids, NOW)
    assert as_set(twice.archived, "id") == {(1,), (2,), (3,)}
    assert as_list(twice.solves.archive, "id") == [(1,), (2,), (3,)]
    repaired = refresh.repair_last_solve(once.teams, once.solves.successes, "team_id")
    assert as_dict(repaired, "id", "last_solve") == {1: None, 2: ts(4)}


def test_cascade(spark):
    tables = {
        "teams": frame(spark, [(1,), (2,)], "id long"),
        "users": frame(spark, [(1, 1), (2, 2), (3, None)], "id long, team_id long"),
        "challenges": frame(spark, [(1,), (2,)], "id long"),
        "challenge_links": frame(spark, [(1, 1), (2, 2)], "id long, challenge_id long"),
        # Attempt 2 was made for team 1 by a user who is on team 2 now.
        "solve_attempts": frame(
            spark, [(1, 1, 1, 1), (2, 2, 1, 1), (3, 2, 2, 2), (4, 3, 2, 1)],
            "id long, user_id long, team_id long, challenge_id long",
        ),
        "solve_successes": frame(
            spark, [(1, 1, 1, 1, 1), (2, 3, 2, 2, 2)],
            "id long, attempt_id long, user_id long, team_id long, challenge_id long",
        ),
        "auth_oauth": frame(spark, [(1, 1), (2, 2)], "id long, user_id long"),
        "deleted_solves": frame(spark, [(9, 1)], "id long, team_id long"),
    }

    def ids(out):
        return {name: {r.id for r in df.collect()} for name, df in out.items()}

    got = ids(removal.cascade_delete(tables, "teams", frame(spark, [(1,)], "id long")))
    assert got == {
        "teams": {2}, "users": {2, 3}, "challenges": {1, 2}, "challenge_links": {1, 2}, "solve_attempts": {3, 4},
        "solve_successes": {2}, "auth_oauth": {2}, "deleted_solves": {9},
    }
    got = ids(removal.cascade_delete(tables, "challenges", frame(spark, [(2,)], "id long")))
    assert got["solve_attempts"] == {1, 2, 4} and got["solve_successes"] == {1} and got["challenge_links"] == {1}
    assert got["users"] == {1, 2, 3}
    got = ids(removal.cascade_delete(tables, "users", frame(spark, [(2,)], "id long")))
    assert got["solve_attempts"] == {1, 4} and got["solve_successes"] == {1} and got["auth_oauth"] == {1}


# --- order and long chains ---------------------------------------------------------------------------------------

CLAIM = "seq long, l string, r string"


def placed(spark, rows, ddl=CLAIM):
    return passes.in_turn(frame(spark, rows, ddl))


def seqs(df):
    return sorted(r["_at"]["seq"] for r in df.collect())


def one_by_one(rows):
    left, right, out = set(), set(), []
    for seq, a, b in sorted(rows):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append(seq)
    return out


def counting(monkeypatch, *modules):
    cuts, real = [], passes.cut
    for m in modules:
        monkeypatch.setattr(m, "cut", lambda df: cuts.append(1) or real(df))
    return cuts


def test_claims_without_seq_and_with_equal_seq(spark):
    rows = [(None, "x", "a"), (None, "x", "a"), (5, "a", "x"), (5, "a", "y"), (5, "a", "x"), (6, "b", "y")]
    got = [(r["_at"]["seq"], r["l"], r["r"]) for r in creation.first_come(placed(spark, rows), "l", "r").collect()]
    assert len(got) == 2 and sum(g[:2] == (5, "a") for g in got) == 1
    assert (6, "b", "y") in got or (5, "a", "y") in got
    assert creation.first_come(placed(spark, rows[:2]), "l", "r").isEmpty()


def test_claims_in_a_chain_take_few_rounds(spark, monkeypatch):
    """A thousand claims that each wait for the one before, beside a hot key and random claims."""
    cuts = counting(monkeypatch, creation, passes)
    chain = [(i, f"l{i // 2}", f"r{(i + 1) // 2}") for i in range(1000)]
    assert seqs(creation.first_come(placed(spark, chain), "l", "r")) == one_by_one(chain)
    assert len(cuts) <= 60  # four a round of the groups, of which there are about a dozen
    rng = random.Random(8)
    rows = [(i, f"a{rng.randrange(60)}", f"b{rng.randrange(60)}" if i % 3 else "hot") for i in range(600)]
    assert seqs(creation.first_come(placed(spark, rows), "l", "r")) == one_by_one(rows)


def test_large_groups_go_on_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(passes, "GROUP", 5)
    chain = [(i, f"l{i // 2}", f"r{(i + 1) // 2}") for i in range(24)] + [(50 + i, f"x{i // 2}", f"y{(i + 1) // 2}") for i in range(4)]
    assert seqs(creation.first_come(placed(spark, chain), "l", "r")) == one_by_one(chain)


def test_groups_of_links(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100), (200, 201), (203, 201), (300, 7)]
    got = as_dict(passes.groups(frame(spark, links, "a long, b long"), "a", "b"), "node", "group")
    want = {i: 1 for i in [*range(1, 41), 300]} | {100: 100, 200: 200, 201: 200, 203: 200}
    assert got == want
    assert passes.groups(frame(spark, [], "a long, b long"), "a", "b").count() == 0


def test_create_teams_without_seq(spark):
    users = frame(spark, [user(1, name="Ann"), user(2, name="Bob")], USER)
    teams = frame(spark, [], "id string, name string, description string, eligible boolean, affiliation string, score int, "
                  "last_solve timestamp_ntz, inserted_at timestamp_ntz, updated_at timestamp_ntz")
    users = users.withColumn("team_id", F.lit(None).cast("string"))
    ddl = "seq long, name string, description string, eligible boolean, affiliation string, founder_id long, auth_ok boolean"
    ask = [(None, "N", "", True, "", 1, True), (4, "T", "", True, "", 1, True), (4, "t", "", True, "", 2, True)]
    made, _, judged = creation.create_teams(teams, users, frame(spark, ask, ddl), NOW)
    assert sorted(r[0] for r in judged.select("outcome").collect()) == ["created", "missing_seq", "name_taken"]
    assert made.count() == 1 and "_at" not in judged.columns


def test_credentials_of_a_user_who_changes_providers(spark, monkeypatch):
    """1,000 accepted commands of one user, under changing providers: as many jobs as for ten."""
    ddl = "seq long, user_id long, old_provider string, old_sub string, new_provider string, new_sub string"
    stored = frame(spark, [(1, "p0", "s0", 10), (2, "p0", "z", 11)], "user_id long, provider_name string, sub string, id long")
    counts = []
    for n in (10, 1000):
        cuts = counting(monkeypatch, credentials, passes)
        rows = [(i, 1, f"p{i % 3}", f"s{i}", f"p{(i + 1) % 3}", f"s{i + 1}") for i in range(n)]
        rows += [(None, 1, "p0", "s0", "p1", "q"), (n, 2, "p0", "no", "p1", "x")]
        now, judged = credentials.update_credentials(stored, frame(spark, rows, ddl), NOW, F.lit(99))
        got = as_set(judged.groupBy("outcome").count(), "outcome", "count")
        assert got == {("stored", n), ("auth", 1), ("missing_seq", 1)}
        assert as_dict(now.where("user_id = 1"), "provider_name", "sub")[f"p{n % 3}"] == f"s{n}"
        counts.append(len(cuts))
    assert counts[0] == counts[1]
