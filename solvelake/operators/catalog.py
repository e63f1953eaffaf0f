"""Entity catalogues, lookups and name checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvelake.functions.common import epoch, fold
from solvelake.schemas import LINK_TYPES

PUBLIC_CHALLENGE = [
    "id", "name", "description", "points", "authors", "hints", "categories", "tags", "solve_count", "visible",
    "source_folder",
]


def public_teams(teams: DataFrame) -> DataFrame:
    """Team rows without password and description."""
    return teams.select("id", "name", "score", epoch("last_solve").alias("last_solve"), "eligible", "affiliation")


def public_users(users: DataFrame) -> DataFrame:
    return users.select(
        "id", "email", "name", "team_id", "score", epoch("last_solve").alias("last_solve"), "eligible", "admin"
    )


def links_by_type(links: DataFrame) -> DataFrame:
    """One row per challenge with one sorted url array per link type."""
    return links.groupBy("challenge_id").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("type") == t, F.col("url")))).alias(f"links_{t}") for t in LINK_TYPES]
    )


def challenge_catalog(challenges: DataFrame, links: DataFrame) -> DataFrame:
    """Challenges (never the flag) with their links, empty arrays where there are none."""
    public = challenges.select(*[c for c in PUBLIC_CHALLENGE if c in challenges.columns])
    by_type = links_by_type(links).withColumnRenamed("challenge_id", "id")
    none = F.array().cast("array<string>")
    out = public.join(by_type, "id", "left")
    return out.withColumns({f"links_{t}": F.coalesce(f"links_{t}", none) for t in LINK_TYPES})


def nest_links(catalog: DataFrame) -> DataFrame:
    """Four link columns to one ``links`` struct."""
    nested = F.struct(*[F.col(f"links_{t}").alias(t) for t in LINK_TYPES])
    return catalog.withColumn("links", nested).drop(*[f"links_{t}" for t in LINK_TYPES])


def flatten_links(nested: DataFrame) -> DataFrame:
    """The ``links`` struct back to four columns."""
    return nested.withColumns({f"links_{t}": F.col("links").getField(t) for t in LINK_TYPES}).drop("links")


def split_links(links: Column) -> list[Column]:
    """A list of (type, location) structs to one array per type, in list order."""

    def only(kind: str) -> Column:
        mine = F.filter(links, lambda link: link["type"] == kind)
        return F.transform(mine, lambda link: link["location"]).alias(f"links_{kind}")

    return [only(t) for t in LINK_TYPES]


def links_of_type(links: DataFrame, kind: str) -> DataFrame:
    if kind not in LINK_TYPES:
        raise ValueError(f"unknown link type {kind!r}")
    return links.where(F.col("type") == kind).select("challenge_id", "url")


def lookup(requests: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Left join ``table`` on an exact key, with ``found``; repeated requests each get their answer."""
    return requests.join(table.withColumn("_hit", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def lookup_by_name(requests: DataFrame, table: DataFrame) -> DataFrame:
    """Left join ``table`` on ``name`` without regard to case, with ``found``; keeps the requested spelling."""
    named = table.withColumn("_key", fold("name")).withColumn("_hit", F.lit(True))
    named = named.withColumnRenamed("name", "stored_name")
    return (
        requests.withColumn("_key", fold("name"))
        .join(named, "_key", "left")
        .withColumn("found", F.coalesce("_hit", F.lit(False)))
        .drop("_key", "_hit")
    )


def name_available(candidates: DataFrame, table: DataFrame) -> DataFrame:
    """``candidates`` with ``available``: no row of ``table`` has this name in any case."""
    taken = table.select(fold("name").alias("_key"), F.lit(True).alias("_taken"))
    return (
        candidates.withColumn("_key", fold("name"))
        .join(taken, "_key", "left")
        .withColumn("available", F.col("_taken").isNull())
        .drop("_key", "_taken")
    )


def folder_to_id(requests: DataFrame, challenges: DataFrame) -> DataFrame:
    """Challenge id per (case-sensitive) source folder, null if unknown."""
    known = challenges.select("source_folder", F.col("id").alias("challenge_id"))
    return requests.join(known, "source_folder", "left")


def id_to_folder(requests: DataFrame, challenges: DataFrame) -> DataFrame:
    known = challenges.select(F.col("id").alias("challenge_id"), "source_folder")
    return requests.join(known, "challenge_id", "left")
