"""Competition tables derived from the order / event test tables.

Suppliers act as teams, customers as users, parts as challenges, events as solve attempts, pages as challenge links
and orders as commands. Every table is derived in full from the rows it is read from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvelake.functions.common import to_second
from solvelake.operators.ledger import check_guesses, first_correct
from solvelake.session import cut

NOW = "2024-02-01 00:00:00"
START = "2024-01-15 00:00:00"

RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(RAW[name]).parquet(f"{sf}/{name}.parquet")


def _rows(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def _text(col: str) -> Column:
    return F.col(col).cast("string")


def teams(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = raw(spark, sf, "nation"), raw(spark, sf, "region")
    s = raw(spark, sf, "supplier")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.col("s_suppkey").cast("int"), F.lit(0).cast("decimal(18,6)"))
    return (
        s.join(nation, s.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("description"),
            F.col("r_name").alias("affiliation"),
            (F.col("s_acctbal") > 0).alias("eligible"),
            (F.lit("2023-01-01 00:00:00").cast("timestamp_ntz") + minutes).alias("inserted_at"),
        )
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in debt have no team; the richest are admins."""
    n = _rows(raw(spark, sf, "supplier"))
    return raw(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_custkey") % n).alias("team_id"),
        (F.col("c_acctbal") > 1000).alias("eligible"),
        (F.col("c_acctbal") > 9500).alias("admin"),
    )


def challenges(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws("-", "p_name", _text("p_partkey")).alias("name"),
        F.col("p_type").alias("description"),
        F.col("p_brand").alias("flag"),
        (100 + 10 * F.col("p_size")).cast("int").alias("points"),
        F.array("p_brand").alias("authors"),
        F.array().cast("array<string>").alias("hints"),
        F.split("p_name", " ").alias("categories"),
        F.array("p_type").alias("tags"),
        (F.col("p_size") > 5).alias("visible"),
        F.concat(F.lit("chall/"), _text("p_partkey")).alias("source_folder"),
    )


def claims(spark: SparkSession, sf: str) -> DataFrame:
    return claims_of(raw(spark, sf, "events"), challenges(spark, sf))


def claims_of(events: DataFrame, challenges: DataFrame) -> DataFrame:
    """Every event (batch or stream) as a solve claim, before admission; purchases guess right."""
    e = events.withColumn("challenge_id", F.get_json_object("props", "$.k").cast("bigint"))
    flags = challenges.select(F.col("id").alias("challenge_id"), "flag")
    return e.join(flags, "challenge_id").select(
        F.col("event_id").alias("id"),
        "user_id",
        "challenge_id",
        to_second("ts").alias("inserted_at"),
        F.when(F.col("event_type") == "purchase", F.col("flag")).otherwise(F.col("event_type")).alias("flag_guess"),
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of users with a team, checked against the flags."""
    u = users(spark, sf).where("team_id is not null").select(F.col("id").alias("user_id"), "team_id")
    return check_guesses(claims(spark, sf).join(u, "user_id"), challenges(spark, sf))


def successes(spark: SparkSession, sf: str) -> DataFrame:
    return first_correct(attempts(spark, sf))


def stored_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """The attempt log as a written table, for queries that read it many times."""
    return cut(attempts(spark, sf))


def stored_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger as a written table, for queries that read it more than once."""
    return cut(successes(spark, sf))


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Five consecutive pages per challenge."""
    kinds = F.array(*[F.lit(t) for t in ("static", "web", "nc", "admin")])
    return raw(spark, sf, "pages").select(
        F.col("page_id").alias("id"),
        F.expr("page_id div 5").alias("challenge_id"),
        "url",
        F.get(kinds, (F.col("page_id") % 4).cast("int")).alias("type"),
    )


def credentials(spark: SparkSession, sf: str) -> DataFrame:
    """One credential per user outside the household segment."""
    return raw(spark, sf, "customer").where("c_mktsegment <> 'HOUSEHOLD'").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("provider_name"),
        F.col("c_name").alias("sub"),
    )


def signins(spark: SparkSession, sf: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    provider = (
        F.when(priority == "1-URGENT", "AUTOMOBILE")
        .when(priority == "2-HIGH", "BUILDING")
        .when(priority == "3-MEDIUM", "FURNITURE")
        .when(priority == "4-NOT SPECIFIED", "HOUSEHOLD")
        .otherwise("MACHINERY")
    )
    return raw(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("Customer#"), F.lpad(_text("o_custkey"), 9, "0")).alias("sub"),
        provider.alias("provider"),
    )


def deploy_log(spark: SparkSession, sf: str) -> DataFrame:
    return deploys_of(raw(spark, sf, "events"))


def deploys_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "click", "building")
        .when(kind == "purchase", "success")
        .when(kind == "error", "failure")
        .when(kind == "signup", "started")
        .otherwise("pulling")
    )
    return events.select(
        F.col("event_id").alias("seq"),
        F.get_json_object("props", "$.k").cast("bigint").alias("chall"),
        status.alias("status"),
        F.col("value").alias("status_time"),
        "ts",
    )
