"""The success ledger and what hangs on it, live."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from solvelake.operators import leaderboard
from solvelake.operators.ledger import PAIR, named
from solvelake.operators.scores import totals, with_points
from solvelake.session import ROCKSDB
from solvelake.sources import buckets
from solvelake.sources.responses import first_blood_outbox
from solvelake.streaming import changes

EVENT_TIME = ["inserted_at", "id"]


def _best(order: list[str], *more: str):
    return F.struct(*order, *[c for c in more if c not in order])


def running_ledger(attempts: DataFrame, order: list[str], bound: changes.Bound | None = None) -> DataFrame:
    """First correct attempt per (challenge, team) of a checked stream.

    With ``EVENT_TIME`` a late attempt displaces a later winner. ``start_arrivals`` is the form in which whoever came in
    first stays. ``bound`` lets state go when its events are over; attempts later than that do not count.
    """
    best = _best(order, "inserted_at", "id", "user_id")
    return changes.running(attempts.where("correct"), PAIR, best, "min", bound)


def start_ledger(
    attempts: DataFrame, path: str, checkpoint: str, order: list[str], bound: changes.Bound | None = None, **kw
) -> StreamingQuery:
    return changes.start(running_ledger(attempts, order, bound), path, checkpoint, "min", **kw)


class FirstArrival(StatefulProcessor):
    """Per (challenge, team), whether an attempt counted; rows pass with ``counted``."""

    def __init__(self, names: list[str]):
        self.order = (names.index("inserted_at"), names.index("id"))
        self.made = Row(*names, "counted")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counted = handle.getValueState("counted", "done boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        over, first = self.counted.exists(), None
        for row in rows:
            if not over and (first is None or self._place(row) < self._place(first)):
                row, first = first, row
            if row is not None:
                yield self.made(*row, False)
        if first is not None:
            self.counted.update((True,))
            yield self.made(*first, True)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.counted.update((True,))

    def close(self) -> None:
        pass

    def _place(self, row: Row) -> tuple:
        return tuple(row[i] for i in self.order)


def arrivals(attempts: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Every attempt of a checked stream with ``counted``: the first correct one per (challenge, team) that comes in,
    of one micro-batch the first by time.

    One row of state per pair says whether it was counted; no clock is asked and nothing written before is read. Only
    correct attempts are shuffled. ``earlier`` is a ledger whose pairs have been counted.
    """
    out = StructType([*attempts.schema.fields, StructField("counted", BooleanType())])
    right = attempts.where("correct").groupBy(*PAIR)
    start = None if earlier is None else earlier.select(*PAIR).distinct().groupBy(*PAIR)
    judged = right.transformWithState(FirstArrival(attempts.columns), out, "Append", "None", start)
    others = attempts.where("not coalesce(correct, false)").withColumn("counted", F.lit(False))
    return judged.unionByName(others)


def start_arrivals(
    attempts: DataFrame, path: str, checkpoint: str, earlier: DataFrame | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Write every attempt with ``counted`` (see ``arrivals``), a folder for each micro-batch. A repeated batch
    overwrites its own folder."""
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(changes.batch_path(path, batch_id))

    return (
        arrivals(attempts, earlier).writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_arrivals(spark: SparkSession, path: str, attempts: DataFrame) -> DataFrame:
    """All attempts so far with ``counted`` and ``batch_id``."""
    more = [StructField("counted", BooleanType()), StructField("batch_id", LongType())]
    return spark.read.schema(StructType([*attempts.schema.fields, *more])).parquet(path)


def _rows(folded: DataFrame) -> DataFrame:
    return folded.select(
        F.col("best.id").alias("attempt_id"),
        F.col("best.user_id").alias("user_id"),
        *PAIR,
        F.col("best.inserted_at").alias("solved_at"),
    )


def read_ledger(spark: SparkSession, path: str, attempts: DataFrame, order: list[str], upto: int | None = None):
    """The ledger as it stands; ``attempts`` is the stream or any frame of its schema."""
    schema = changes.log_schema(running_ledger(attempts, order))
    return _rows(changes.fold(changes.read_log(spark, path, schema, upto), PAIR, "min"))


def start_leaderboard(
    attempts: DataFrame,
    teams: DataFrame,
    challenges: DataFrame,
    ledger_path: str,
    scores_path: str,
    board_path: str,
    checkpoint: str,
    limit: int,
    bound: changes.Bound | None = None,
    parts: int = buckets.BUCKETS,
    **kw,
) -> StreamingQuery:
    """Keep the event-time ledger and the top teams up to date.

    ``scores_path`` holds the teams and their counted solves in ``parts`` buckets of teams. A micro-batch reads and
    rewrites the buckets of the teams it touched, and under ``board_path`` the top ``limit`` teams of these buckets;
    ``latest_board`` merges the tops of all. A repeated batch starts from the versions before it.
    """
    leaderboard.check_limit(limit)
    spark = attempts.sparkSession
    team = ["team_id"]
    known, solved = f"{scores_path}/teams", f"{scores_path}/solves"
    ties = teams.select(F.col("id").alias("team_id"), "inserted_at")
    ids = dict(teams.dtypes)["id"]
    own = f"attempt_id {dict(attempts.dtypes)['id']}, user_id {dict(attempts.dtypes)['user_id']}, challenge_id " \
        f"{dict(attempts.dtypes)['challenge_id']}, team_id {ids}, solved_at timestamp_ntz"

    def tops(session: SparkSession, changed: list[int], version: int) -> None:
        """The top teams of each of the buckets, as of ``version``."""
        solves = buckets.read(session, solved, own, changed, version)
        scored = totals(with_points(solves, challenges), "team_id")
        all_ = buckets.read(session, known, ties.schema, changed).join(scored, "team_id", "left")
        all_ = all_.withColumn("score", F.coalesce("score", F.lit(0).cast("bigint"))).withColumnRenamed("team_id", "id")
        all_ = all_.withColumn("_part", buckets.bucket_of(["id"], parts))
        place = F.row_number().over(Window.partitionBy("_part").orderBy(*leaderboard.order()))
        best = all_.withColumn("_place", place).where(F.col("_place") <= limit).select("id", "score", "last_solve", "inserted_at")
        buckets.rewrite(best, board_path, ["id"], changed, version, parts)

    if not buckets.manifest(spark, known):
        buckets.rewrite(ties, known, team, list(range(parts)), -1, parts)
        tops(spark, list(range(parts)), -1)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        changed = buckets.touched(batch, team, parts)
        if changed:
            fresh = _rows(batch)
            before = buckets.read(session, solved, own, changed, batch_id - 1)
            kept = before.join(fresh.select(*PAIR), PAIR, "left_anti")
            buckets.rewrite(kept.unionByName(fresh), solved, team, changed, batch_id, parts)
            tops(session, changed, batch_id)

    return changes.start(running_ledger(attempts, EVENT_TIME, bound), ledger_path, checkpoint, "min", then=refresh, **kw)


def top_of(teams: DataFrame, team_scores: DataFrame, limit: int) -> DataFrame:
    scored = teams.drop("score", "last_solve").join(
        team_scores.withColumnRenamed("team_id", "id"), "id", "left"
    )
    zero = F.lit(0).cast("bigint")
    return leaderboard.top_teams(scored.withColumn("score", F.coalesce("score", zero)), limit).select(
        "rank", "id", "score", "last_solve"
    )


def latest_board(spark: SparkSession, board_path: str, limit: int, id_type: str = "string") -> DataFrame:
    """The first ``limit`` teams (no more than the stream keeps) as of the last finished batch: the tops of all buckets,
    merged."""
    ddl = f"id {id_type}, score bigint, last_solve timestamp_ntz, inserted_at timestamp_ntz"
    best = leaderboard.top_teams(buckets.read(spark, board_path, ddl), limit)
    return best.select("rank", "id", "score", "last_solve")


def start_first_bloods(
    attempts: DataFrame,
    challenges: DataFrame,
    teams: DataFrame,
    users: DataFrame,
    path: str,
    outbox_path: str,
    checkpoint: str,
    **kw,
) -> StreamingQuery:
    """Announce the first solver of each challenge once.

    A batch announces the challenges no earlier batch has announced; a late attempt does not announce one again. The
    outbox rows carry the challenge id, so that batches can be told apart from one another after a restart.
    """
    best = _best(EVENT_TIME, "inserted_at", "id", "user_id", "team_id")
    result = changes.running(attempts.where("correct"), ["challenge_id"], best, "min")
    id_type = dict(challenges.dtypes)["id"]
    ddl = f"challenge_id {id_type}, attempt_id {dict(attempts.dtypes)['id']}, channel string, username string, " \
        "content string, batch_id bigint"

    def announce(batch: DataFrame, batch_id: int) -> None:
        won = batch.select(
            "challenge_id",
            F.col("best.id").alias("attempt_id"),
            F.col("best.user_id").alias("user_id"),
            F.col("best.team_id").alias("team_id"),
        )
        if batch_id > 0:
            told = batch.sparkSession.read.schema(ddl).parquet(outbox_path).where(F.col("batch_id") < batch_id)
            won = won.join(told.select("challenge_id"), "challenge_id", "left_anti")
        known = challenges.select(F.col("id").alias("challenge_id"), F.col("name").alias("chall"))
        details = named(named(won.join(known, "challenge_id"), teams, "team_id", "team"), users, "user_id", "user")
        rows = first_blood_outbox(details, keep=["challenge_id", "attempt_id"])
        rows.write.mode("overwrite").parquet(changes.batch_path(outbox_path, batch_id))

    return changes.start(result, path, checkpoint, "min", then=announce, **kw)


def read_outbox(spark: SparkSession, outbox_path: str, id_type: str = "string") -> DataFrame:
    ddl = f"challenge_id {id_type}, attempt_id {id_type}, channel string, username string, content string"
    return spark.read.schema(ddl + ", batch_id bigint").parquet(outbox_path)
