from __future__ import annotations

from helpers import as_set, frame, ts

from solvelake.functions import sql
from solvelake.operators import scores


def test_sql_names(spark):
    teams = frame(
        spark, [(1, 30, ts(5), ts(0)), (2, 0, None, ts(0))],
        "id long, score long, last_solve timestamp_ntz, inserted_at timestamp_ntz",
    )
    users = frame(spark, [(7,), (8,)], "id long")
    challenges = frame(spark, [(1, 10), (2, 20)], "id long, points int")
    links = frame(spark, [(1, "u", "web"), (1, "n", "nc")], "challenge_id long, url string, type string")
    ledger = frame(
        spark, [(1, 7, 1, 1, ts(1)), (2, 7, 2, 1, ts(5))],
        "attempt_id long, user_id long, challenge_id long, team_id long, solved_at timestamp_ntz",
    )
    sql.register(spark, teams, users, challenges, links, ledger)
    teams.createOrReplaceTempView("t")
    got = spark.sql("select id, get_score_team(id) score from t")
    assert as_set(got, "id", "score") == {(1, 30), (2, 0)}
    one = spark.sql("select get_score_user(7L), get_score_user(9L), get_solves_chall(1L), get_score_team(99L)").first()
    assert tuple(one) == (30, 0, 1, 0)
    assert [r.url for r in spark.sql("select * from links_of_type(1L, 'web')").collect()] == ["u"]
    assert [r.id for r in spark.sql("select * from get_top_n_teams(1)").collect()] == [1]


def test_score_at_an_instant(spark):
    """Edges of seconds and hours, against the operator; joins by keys only."""
    schema = "id long, score long, last_solve timestamp_ntz, inserted_at timestamp_ntz"
    teams = frame(spark, [(i, 0, None, ts(0)) for i in (1, 2, 3)], schema)
    users = frame(spark, [(7,)], "id long")
    challenges = frame(spark, [(i, 10**i) for i in range(1, 8)], "id long, points int")
    links = frame(spark, [(1, "u", "web")], "challenge_id long, url string, type string")
    times = {1: 0, 2: 0, 3: 1, 4: 3599, 5: 3600, 6: 7200, 7: 90000}
    ledger = frame(
        spark, [(c, 7, c, 1, ts(t)) for c, t in times.items()] + [(9, 7, 1, 2, ts(3600))],
        "attempt_id long, user_id long, challenge_id long, team_id long, solved_at timestamp_ntz",
    )
    sql.register(spark, teams, users, challenges, links, ledger, prefix="at_")
    instants = [-1, 0, 1, 2, 3599, 3600, 3601, 7199, 7200, 7201, 50000, 90000, 90001]
    rows = [(t, ts(s)) for t in (1, 2, 3, 99) for s in instants] + [(1, ts(2)), (1, None), (None, ts(5))]
    probes = frame(spark, rows, "team_id long, at timestamp_ntz")
    probes.createOrReplaceTempView("at_probes")
    got = spark.sql("select team_id, at, at_get_team_score_at(team_id, at) score from at_probes")
    pick = lambda df: sorted(map(repr, df.select("team_id", "at", "score").collect()))
    assert pick(got) == pick(scores.score_at(probes, ledger, challenges))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
