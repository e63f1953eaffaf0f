"""Streaming queries, run over the files at hand and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvelake.functions.common import epoch
from solvelake.operators.ledger import check_guesses
from solvelake.plans.leaderboard import TOP
from solvelake.plans.registry import query
from solvelake.plans.text import BODIES, BODY
from solvelake.session import work_path
from solvelake.sources import testbed as tb
from solvelake.streaming import ledger, sources, status


#: Micro-batches of a streaming query: the events by the remainder of their id, so that most come late.
BATCHES = 4
#: Rows of a file of a micro-batch, about; more rows make more files, not larger ones.
FILE_ROWS = 250_000


def events(spark, sf):
    path = work_path(spark, "events")
    rows = tb.raw(spark, sf, "events")
    files = max(1, rows.count() // (BATCHES * FILE_ROWS))
    for i in range(BATCHES):
        # As many files for each micro-batch, dealt by turns; a later batch has later files.
        rows.where(F.col("event_id") % BATCHES == i).repartition(files).write.parquet(f"{path}/part={i}")
    return sources.read_files(spark, f"{path}/*", tb.RAW["events"], per_trigger=files)


def attempt_stream(spark, sf):
    """The event stream as checked attempts: stream-static joins with the challenges and users."""
    u = tb.users(spark, sf).where("team_id is not null").select(F.col("id").alias("user_id"), "team_id")
    c = tb.challenges(spark, sf)
    claims = tb.claims_of(events(spark, sf), c)
    return check_guesses(claims.join(u, "user_id"), c)


def done(q):
    q.awaitTermination()


LEDGER = "select attempt_id, user_id, challenge_id, team_id, cast(epoch(solved_at) as bigint) solved_at from successes"


@query(
    "stream_first_correct",
    f"""
    select id, batch_id, correct, correct and rn = 1 counted from (
      select *, row_number() over (partition by challenge_id, team_id, correct order by batch_id, inserted_at, id) rn
      from (select *, id % {BATCHES} batch_id from attempts))
    """,
)
def stream_first_correct(spark, sf):
    """Every attempt, counted by arrival; within one micro-batch by time."""
    attempts = attempt_stream(spark, sf)
    path = work_path(spark, "arrivals")
    done(ledger.start_arrivals(attempts, path, work_path(spark, "checkpoint")))
    return ledger.read_arrivals(spark, path, attempts).select("id", "batch_id", "correct", "counted")


@query("stream_ledger", LEDGER)
def stream_ledger(spark, sf):
    """Counted by event time."""
    attempts = attempt_stream(spark, sf)
    path = work_path(spark, "ledger")
    done(ledger.start_ledger(attempts, path, work_path(spark, "checkpoint"), ledger.EVENT_TIME, compact_every=2))
    return ledger.read_ledger(spark, path, attempts, ledger.EVENT_TIME).withColumn("solved_at", epoch("solved_at"))


@query(
    "stream_leaderboard",
    "select cast(rank as bigint) rank, id, score, cast(epoch(last_solve) as bigint) last_solve from top",
    TOP.format(n=10),
)
def stream_leaderboard(spark, sf):
    board = work_path(spark, "board")
    q = ledger.start_leaderboard(
        attempt_stream(spark, sf), tb.teams(spark, sf), tb.challenges(spark, sf),
        work_path(spark, "ledger"), work_path(spark, "scores"), board, work_path(spark, "checkpoint"), 10,
        compact_every=2, parts=8,
    )
    done(q)
    return ledger.latest_board(spark, board, 10, "bigint").withColumn("last_solve", epoch("last_solve"))


@query(
    "stream_first_blood",
    f"""
    select f.id attempt_id, f.challenge_id, 'participants' channel, 'CTF Updates' username,
           'First :drop_of_blood: by `' || u.name || '` from `' || t.name || '` on challenge `' || c.name || '`!' content
    from (select *, row_number() over (partition by challenge_id order by id % {BATCHES}, inserted_at, id) rn
          from attempts where correct) f
    join challenges c on c.id = f.challenge_id join teams t on t.id = f.team_id join users u on u.id = f.user_id
    where rn = 1
    """,
)
def stream_first_blood(spark, sf):
    """A challenge is announced by the first batch that has a solver."""
    box = work_path(spark, "outbox")
    q = ledger.start_first_bloods(
        attempt_stream(spark, sf), tb.challenges(spark, sf), tb.teams(spark, sf), tb.users(spark, sf),
        work_path(spark, "bloods"), box, work_path(spark, "checkpoint"),
    )
    done(q)
    return ledger.read_outbox(spark, box, "bigint").drop("batch_id")


@query(
    "stream_deploy_status",
    """
    select chall, status, status_time from deploy_log d
    where (ts, seq) = (select (b.ts, b.seq) from deploy_log b where b.chall = d.chall
                       order by b.ts desc, b.seq desc limit 1)
    """,
)
def stream_deploy_status(spark, sf):
    log = tb.deploys_of(events(spark, sf))
    path = work_path(spark, "status")
    done(status.start_status(log, path, work_path(spark, "checkpoint")))
    return status.read_status(spark, path, log).select("chall", "status", "status_time")


@query(
    "stream_routed_commands",
    """
    select request_id, target, kind from kinds where request_id not in (select request_id from refused)
    union all
    select request_id, 'refused', reason from refused
    """,
    BODIES,
)
def stream_routed_commands(spark, sf):
    """The bodies of the events, those of errors delivered twice as by a client that asks again; each is routed once."""
    again = F.when(F.col("event_type") == "error", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    bodies = events(spark, sf).withColumn("delivery", F.explode(again)).select(
        F.col("event_id").alias("request_id"), F.expr(BODY.replace("{s}", "string")).alias("body")
    )
    path = work_path(spark, "routed")
    done(sources.start_routing(bodies, path, work_path(spark, "checkpoint"), "bigint"))
    ddl = "request_id bigint, kind string, params string, target string"
    return spark.read.schema(ddl).parquet(path).select("request_id", "target", "kind")
