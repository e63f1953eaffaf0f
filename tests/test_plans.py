"""Plans that must keep their shape, and hot keys."""

from __future__ import annotations

import contextlib

import pytest
from helpers import frame, ts
from pyspark.sql import functions as F

from solvelake.operators import access, leaderboard, ledger, patches, quality, scores
from solvelake.plans import QUERIES
from solvelake.session import cut
from solvelake.sources import testbed as tb

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@contextlib.contextmanager
def settings(spark, **conf):
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_top_teams_takes_ordered(spark):
    t = QUERIES["top_teams"](spark, SMALL)
    assert "TakeOrderedAndProject" in plan(t)


def test_ledger_combines_before_the_shuffle(spark):
    text = plan(tb.successes(spark, SMALL))
    assert text.count("partial_min") >= 1


def test_scans_read_only_what_they_need(spark):
    counts = QUERIES["chall_solve_counts"](spark, SMALL)
    text = plan(counts)
    assert "html" not in text and "p_retailprice" not in text and "value:double" not in text
    credentials = plan(tb.credentials(spark, SMALL).select("user_id"))
    assert "PushedFilters: [IsNotNull(c_mktsegment), Not(EqualTo(c_mktsegment,HOUSEHOLD))]" in credentials


def test_envelopes_are_judged_without_a_shuffle(spark):
    assert "Exchange" not in plan(QUERIES["envelope_commands"](spark, SMALL))


HOT = dict(
    spark__sql__autoBroadcastJoinThreshold="-1",
    spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
    spark__sql__adaptive__advisoryPartitionSizeInBytes="50KB",
    spark__sql__adaptive__coalescePartitions__enabled="false",
)


def hot_attempts(spark, n=200_000):
    """One team guesses one challenge in two thirds of all attempts."""
    i = F.col("id")
    hot = i % 3 != 0
    return spark.range(0, n, numPartitions=8).select(
        "id",
        F.when(hot, F.lit(1)).otherwise(i % 997).alias("user_id"),
        F.when(hot, F.lit(1)).otherwise(i % 499).alias("team_id"),
        F.when(hot, F.lit(1)).otherwise(i % 101).alias("challenge_id"),
        F.when(i % 5 == 0, "yes").otherwise(F.concat(F.lit("no"), F.md5(i.cast("string")))).alias("flag_guess"),
        F.timestamp_seconds(F.lit(1704067200) + i % 3600).cast("timestamp_ntz").alias("inserted_at"),
    )


def test_a_hot_pair_is_split(spark):
    a = hot_attempts(spark)
    c = spark.range(101).select("id", F.lit("yes").alias("flag"), F.lit(10).alias("points"))
    with settings(spark, **HOT):
        out = ledger.adjudicate(a, c)
        done = out.select("id", "counted", "already_solved")
        rows = done.collect()
        assert "skew=true" in plan(done)
    pairs = ledger.check_guesses(a, c).where("correct").select("challenge_id", "team_id").distinct().count()
    assert len(rows) == 200_000 and sum(r.counted for r in rows) == pairs


def test_a_hot_user_is_split_at_sign_in(spark):
    asks = hot_attempts(spark).select(
        "id", "user_id", F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("sub"), F.lit("p").alias("provider"),
        "flag_guess",
    )
    creds = spark.range(0, 997).select(
        F.col("id").alias("user_id"), F.lit("p").alias("provider_name"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("sub")
    )
    with settings(spark, **HOT):
        out = access.oauth_matches(asks, creds)
        assert len(out.where("matches").select("id", "flag_guess").collect()) == 200_000
        done = out.select("id", "flag_guess", "matches")
        done.collect()
        assert "skew=true" in plan(done)


def test_history_windows_stay_small_for_a_hot_team(spark):
    """No window partition holds more rows than an hour has seconds."""
    led = hot_attempts(spark, 30_000).select(
        F.col("id").alias("attempt_id"), "user_id", F.col("id").alias("challenge_id"), "team_id",
        F.col("inserted_at").alias("solved_at"),
    )
    c = spark.range(30_000).select("id", F.lit(1).alias("points"))
    got = scores.score_history(led, c, "2024-01-01 00:30:00")
    last = got.where("team_id = 1").agg(F.max("score")).first()[0]
    own = led.where("team_id = 1 and solved_at < timestamp_ntz'2024-01-01 00:59:59'").count()
    assert last == own + 1


def test_patches_combine_before_the_shuffle(spark):
    p = frame(spark, [(1, 1, "b", None, None)], "seq long, user_id long, name string, eligible boolean, admin boolean")
    assert "partial_max(" in plan(patches.fold_patches(p, "user_id", ["name", "eligible", "admin"]))


def test_limit_is_checked_before_any_plan():
    with pytest.raises(ValueError, match="101"):
        leaderboard.top_teams(None, 101)


@pytest.mark.parametrize(("name", "scans"), [("orphans", 22), ("cascade_delete", 16), ("attempt_batch", 10), ("top_teams_history", 9)])
def test_few_scans(spark, name, scans):
    """Children are read once, whatever the number of their parents, and deleted sets are written once."""
    assert plan(QUERIES[name](spark, SMALL)).count("FileScan") <= scans


def test_commands_are_judged_once_for_links(spark):
    """The check of the lists and the links after the upserts read stored lists, not the commands again."""
    text = plan(QUERIES["replace_links"](spark, SMALL))
    assert "o_orderkey" not in text and text.count("FileScan") == 3


def test_readers_of_upserts_take_only_their_columns(spark):
    text = plan(QUERIES["upsert_challenges"](spark, SMALL).select("id"))
    assert "new_name" in text and "new_links" not in text and "new_description" not in text
    assert "FileScan" in plan(QUERIES["upsert_challenge_outcomes"](spark, SMALL))


def test_unique_keys_are_checked_by_change(spark):
    """The table is read for the keys that a batch writes, and is neither counted nor shuffled for that."""
    after = cut(tb.users(spark, SMALL).select("id", "name", (F.col("id") < 5).alias("_wrote")))
    text = plan(quality.change_duplicates(after, cut(after.where("_wrote").select("name")), "users"))
    assert "LeftSemi, BuildRight" in text and text.count("FileScan") == 2
    # Only rows that hold a written key are shuffled, to be counted.
    assert text.count("Exchange hashpartitioning") == 1
