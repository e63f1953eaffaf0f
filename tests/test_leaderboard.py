from __future__ import annotations

from helpers import as_dict, frame, ts

from solvelake.functions import sql
from solvelake.operators import leaderboard

TEAM = "id long, name string, score int, last_solve timestamp_ntz, inserted_at timestamp_ntz"
ROWS = [(i, f"t{i}", (i * 7) % 40, ts(i % 13) if i % 3 else None, ts(i % 5)) for i in range(1000)]


def expected():
    late = ts(10**9)
    order = sorted(ROWS, key=lambda r: (-r[2], r[3] or late, r[4], r[0]))
    return {r[0]: n for n, r in enumerate(order, 1)}


def test_ranks_of_all_teams(spark):
    assert as_dict(leaderboard.ranked(frame(spark, ROWS, TEAM)), "id", "rank") == expected()
    assert leaderboard.ranked(frame(spark, [], TEAM)).count() == 0


def test_sql_names_have_no_cap_and_stand_side_by_side(spark):
    teams = frame(spark, ROWS, TEAM)
    users = frame(spark, [(1, 1)], "id long, team_id long")
    challenges = frame(spark, [(1, 10)], "id long, points int")
    links = frame(spark, [(1, "u", "web")], "challenge_id long, url string, type string")
    ledger = frame(spark, [(1, 1, 1, 1, ts(0))], "attempt_id long, user_id long, challenge_id long, team_id long, solved_at timestamp_ntz")
    sql.register(spark, teams, users, challenges, links, ledger, prefix="a_")
    sql.register(spark, teams.where("id < 3"), users, challenges, links, ledger, prefix="b_")
    top = {r[0] for r in spark.sql("select id from a_get_top_n_teams(500)").collect()}
    assert top == {i for i, n in expected().items() if n <= 500}
    assert spark.sql("select id from b_get_top_n_teams(500)").count() == 3
    assert spark.sql("select a_get_score_team(1), a_get_score_user(1), a_get_solves_chall(1)").first() == (10, 10, 1)
    assert [r[0] for r in spark.sql("select url from a_links_of_type(1, 'web')").collect()] == ["u"]
