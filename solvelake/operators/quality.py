"""Constraints as jobs: each check reports the rows or counts that break it."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvelake import schemas
from solvelake.functions.common import fold
from solvelake.operators.scores import solve_counts, totals, with_points


def duplicates(df: DataFrame, keys: list[str], folded: Iterable[str] = ()) -> DataFrame:
    """(keys, n) for every key that occurs more than once; keys with a null part never clash."""
    folded = set(folded)
    cols = [(fold(k) if k in folded else F.col(k)).alias(k) for k in keys]
    return df.dropna(subset=keys).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _entries(df: DataFrame, table: str, keys: list[list[str]], *more: str) -> DataFrame:
    """(key, value, sizes, and the columns ``more``): one row for each of ``keys`` without a null part."""
    folded = schemas.FOLDED.get(table, ())
    parts = []
    for k in keys:
        texts = [(fold(c) if c in folded else F.col(c).cast("string")) for c in k]
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in k])
        # Parts are told apart by their lengths too: a comma may stand in any of them.
        sizes = F.concat_ws(",", *[F.length(t).cast("string") for t in texts])
        entry = F.struct(F.lit(",".join(k)).alias("key"), F.concat_ws(",", *texts).alias("value"), sizes.alias("sizes"))
        parts.append(F.when(whole, entry))
    return df.select(F.inline(F.array_compact(F.array(*parts))), *more)


def _keys(df: DataFrame, table: str) -> list[list[str]]:
    return [k for k in [schemas.PRIMARY_KEYS[table], *schemas.UNIQUE.get(table, [])] if set(k) <= set(df.columns)]


def table_duplicates(df: DataFrame, table: str) -> DataFrame:
    """(table, key, value, n) over the primary and unique keys of ``table`` that ``df`` has, in one pass."""
    rows = _entries(df, table, _keys(df, table))
    counted = rows.groupBy("key", "value", "sizes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counted.select(F.lit(table).alias("table"), "key", "value", "n")


def _refuse(clashes: DataFrame, table: str) -> None:
    found = clashes.limit(5).collect()
    if found:
        shown = "; ".join(f"{r['key']}={r['value']} ({r['n']} rows)" for r in found)
        raise ValueError(f"unique keys of {table} violated: {shown}")


def require_unique(df: DataFrame, table: str) -> DataFrame:
    """``df`` itself, or a ValueError that names some clashing keys: a batch that would break a key is not written.

    Hashes of the keys are counted first, and the keys themselves only if a hash comes twice.
    """
    hashes = _entries(df, table, _keys(df, table)).select(F.xxhash64("key", "value", "sizes").alias("hash"))
    if not hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        _refuse(table_duplicates(df, table), table)
    return df


def change_duplicates(rows: DataFrame, written: DataFrame, table: str) -> DataFrame:
    """(table, key, value, n) for the unique keys that a batch writes and that clash in ``rows``, the table after it.

    ``rows`` has the key columns and ``_wrote``, true for rows whose keys the batch may have changed. ``written`` has
    all values that the batch may write, by key column, without the table. Rows with other values are not shuffled, as
    long as ``written`` is small enough for the planner to send to every task.
    """
    keys = _keys(written, table)
    entry = ["key", "value", "sizes"]
    met = _entries(rows, table, keys, "_wrote").join(_entries(written, table, keys), entry, "left_semi")
    counted = met.groupBy(*entry).agg(F.count(F.lit(1)).alias("n"), F.max("_wrote").alias("_wrote"))
    return counted.where("n > 1 and _wrote").select(F.lit(table).alias("table"), "key", "value", "n")


def unless_clashes(out: DataFrame, clashes: DataFrame, table: str) -> DataFrame:
    """``out``, which fails when it is used if there are ``clashes`` (see ``change_duplicates``), and names one of them.

    The check is a subquery of the same plan: what it shares with ``out`` is computed once, and no row is given out
    before it is done.
    """
    named = F.concat(F.lit(f"unique keys of {table} violated: "), "key", F.lit("="), "value", F.lit(" ("), F.col("n").cast("string"), F.lit(" rows)"))
    found = clashes.agg(F.min(named).alias("clash")).scalar()
    return out.where(F.when(found.isNull(), F.lit(True)).otherwise(F.raise_error(found).cast("boolean")))


def orphans(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Rows of ``child`` whose non-null ``column`` points to no row of ``parent``."""
    ids = parent.select(F.col("id").alias(column))
    return child.where(F.col(column).isNotNull()).join(ids, column, "left_anti")


def all_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, column, parent, n): orphan counts along every foreign key between the given tables."""
    reports = []
    for child, rows in tables.items():
        keys = [(col, p) for c, col, p in schemas.FOREIGN_KEYS if c == child and p in tables and col in rows.columns]
        if not keys:
            continue
        # One pass over the child: how often each key value occurs in each column, joined with all ids of all parents.
        used = rows.select(
            F.inline(F.array(*[F.struct(F.lit(col).alias("column"), F.lit(p).alias("parent"), F.col(col).alias("id")) for col, p in keys]))
        ).where("id is not null")
        counted = used.groupBy("column", "parent", "id").agg(F.count(F.lit(1)).alias("n"))
        ids = reduce(
            DataFrame.unionByName, [tables[p].select(F.lit(p).alias("parent"), "id") for p in dict.fromkeys(p for _, p in keys)]
        )
        lost = counted.join(ids, ["parent", "id"], "left_anti").groupBy("column", "parent").agg(F.sum("n").alias("n"))
        every = rows.sparkSession.createDataFrame(keys, "column string, parent string")
        reports.append(
            F.broadcast(every).join(lost, ["column", "parent"], "left")
            .select(F.lit(child).alias("child"), "column", "parent", F.coalesce("n", F.lit(0)).alias("n"))
        )
    return reduce(DataFrame.unionByName, reports)


def _counts(df: DataFrame, checks: dict[str, Column], as_: str) -> DataFrame:
    """One pass over ``df``: (``as_``, n) with the number of rows that meet each condition."""
    counted = df.agg(*[F.count_if(cond).alias(name) for name, cond in checks.items()])
    return counted.unpivot([], list(checks), as_, "n")


def null_violations(df: DataFrame, table: str) -> DataFrame:
    """(column, n): nulls in the required columns that ``df`` has."""
    free = schemas.NULLABLE.get(table, set())
    required = [f.name for f in schemas.schema(table).fields if f.name not in free and f.name in df.columns]
    return _counts(df, {c: F.col(c).isNull() for c in required}, "column")


def domain_violations(df: DataFrame, table: str) -> DataFrame:
    """(column, n): values outside their enumeration, and texts of more than 255 characters."""
    checks = {c: ~F.col(c).isin(*values) for c, values in schemas.ENUMS.get(table, {}).items() if c in df.columns}
    for c in schemas.SHORT_TEXT.get(table, []):
        if c in df.columns:
            checks[c] = F.char_length(c) > 255
    for c in schemas.SHORT_TEXT_ARRAYS.get(table, []):
        if c in df.columns:
            checks[c] = F.exists(c, lambda x: F.char_length(x) > 255)
    return _counts(df, checks, "column")


def enum_violations(df: DataFrame, values: dict[str, list[str]]) -> DataFrame:
    """(column, n): values outside the given lists, such as ``schemas.DEPLOY_STATUSES``."""
    return _counts(df, {c: ~F.col(c).isin(*allowed) for c, allowed in values.items()}, "column")


def ledger_faults(ledger: DataFrame, attempts: DataFrame) -> DataFrame:
    """(attempt_id, fault) for ledger rows whose attempt is missing, wrong, or of another user, team or challenge."""
    same = ["user_id", "team_id", "challenge_id"]
    a = attempts.select(F.col("id").alias("attempt_id"), "correct", *[F.col(c).alias(f"a_{c}") for c in same])
    fault = F.when(F.col("correct").isNull(), "no_attempt").when(~F.col("correct"), "not_correct")
    for c in same:
        fault = fault.when(~F.col(c).eqNullSafe(F.col(f"a_{c}")), f"other_{c}")
    out = ledger.join(a, "attempt_id", "left").withColumn("fault", fault)
    return out.where("fault is not null").select("attempt_id", "fault")


def score_drift(owners: DataFrame, ledger: DataFrame, challenges: DataFrame, key: str) -> DataFrame:
    """(id, stored, derived) for owners whose stored score is not that of the ledger."""
    sums = totals(with_points(ledger, challenges), key).select(F.col(key).alias("id"), F.col("score").alias("derived"))
    stored = owners.select("id", F.col("score").cast("bigint").alias("stored"))
    out = stored.join(sums, "id", "left").withColumn("derived", F.coalesce("derived", F.lit(0).cast("bigint")))
    return out.where(~F.col("stored").eqNullSafe(F.col("derived")))


def count_drift(challenges: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, stored, derived) for challenges whose stored solve count is not that of the ledger."""
    counts = solve_counts(challenges, ledger).withColumnsRenamed({"challenge_id": "id", "solve_count": "derived"})
    stored = challenges.select("id", F.col("solve_count").cast("bigint").alias("stored"))
    return stored.join(counts, "id").where(~F.col("stored").eqNullSafe(F.col("derived")))
