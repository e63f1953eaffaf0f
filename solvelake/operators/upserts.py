"""Challenge upserts and link replacement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvelake.functions.common import stable_id, stamp
from solvelake.operators.joins import split_join
from solvelake.operators.quality import change_duplicates, require_unique, unless_clashes
from solvelake.schemas import LINK_TYPES
from solvelake.session import cut

UPSERT_FIELDS = ["name", "description", "flag", "points", "authors", "hints", "categories", "tags", "visible"]


def replace_links(
    links: DataFrame, challenges: DataFrame, replacements: DataFrame, new_id: Column | None = None, unique: bool = True
) -> DataFrame:
    """Replace all links of the listed challenges; lists for unknown challenges insert nothing.

    ``replacements`` is (challenge_id, links array<struct<type, location>>). ``new_id`` may use challenge_id, url
    and type. Lists that name a url of a challenge twice are refused, with a ValueError, unless ``unique`` is false.
    """
    # The lists may come from a long plan: they are computed once, and both the check and the result read them.
    ids = challenges.select(F.col("id").alias("challenge_id"), F.lit(True).alias("_known")).distinct()
    lists = cut(split_join(replacements.select("challenge_id", "links"), ids, ["challenge_id"]))
    made = lists.where("_known").select("challenge_id", F.explode("links").alias("link")).select(
        "challenge_id", F.col("link.location").alias("url"), F.col("link.type").alias("type")
    )
    made = made.withColumn("id", stable_id("link", "challenge_id", "url", "type") if new_id is None else new_id)
    kept = links.join(lists.select("challenge_id"), "challenge_id", "left_anti")
    if unique:
        require_unique(made, "challenge_links")
    return kept.select("id", "challenge_id", "url", "type").unionByName(made.select("id", "challenge_id", "url", "type"))


def link_list(**arrays: Column) -> Column:
    """Four url arrays (nc, web, admin, static) as one list of (type, location) structs."""

    def typed(kind: str, urls: Column) -> Column:
        return F.transform(urls, lambda url: F.struct(F.lit(kind).alias("type"), url.alias("location")))

    return F.concat(*[typed(kind, arrays[kind]) for kind in LINK_TYPES if kind in arrays])


def upsert_challenges(
    challenges: DataFrame,
    commands: DataFrame,
    children: list[DataFrame],
    now: str | None,
    new_id: Column | None = None,
    unique: bool = True,
    stored: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Create or overwrite challenges by ``source_folder``, as if applied in ``seq`` order.

    ``commands`` is (seq, id or null, source_folder, the upsert fields, links). The last command per folder stands.
    An id given explicitly replaces the stored one, but not if rows of ``children`` (frames with a ``challenge_id``)
    hang on that: such commands are rejected, as are those without a ``seq``. ``new_id`` names created challenges and may use source_folder.

    A batch after which a challenge that it wrote shares its id or name with another is refused as a whole, unless
    ``unique`` is false: the returned challenges and links fail when they are used. Only the keys that the batch writes
    are met with the table.

    The commands that stand are stored, as the challenges, the links and the check all read them. Callers that want no
    more than the outcomes do without, by ``stored``.

    Returns the challenges, the link replacements for ``replace_links``, and the commands with ``outcome``.
    """
    # Only challenges for which a command gives another id can be pinned; the children of the others are not looked at.
    asked = commands.where("id is not null").select("source_folder", F.col("id").alias("_asked"))
    moved = challenges.select(F.col("id").alias("challenge_id"), "source_folder").join(asked, "source_folder")
    moved = cut(moved.where("_asked <> challenge_id").select("challenge_id", "source_folder").distinct())
    # Distinct before any join: a challenge with much of the rows is one row of each task.
    parents = reduce(DataFrame.unionByName, [c.select("challenge_id") for c in children]).distinct()
    # Stored, so that the planner knows their size: commands are not shuffled to be met with a few folders.
    pinned = cut(
        moved.join(parents, "challenge_id", "left_semi")
        .select("source_folder", F.col("challenge_id").alias("_pinned"))
    )
    clash = F.col("_pinned").isNotNull() & F.col("id").isNotNull() & (F.col("id") != F.col("_pinned"))
    judged = split_join(commands, pinned, ["source_folder"]).withColumn(
        "outcome", F.when(F.col("seq").isNull(), "missing_seq").when(clash, "id_in_use").otherwise("stored")
    ).drop("_pinned")

    last = (
        judged.where("outcome = 'stored'")
        .groupBy("source_folder")
        .agg(
            F.max(F.struct("seq", F.struct(*UPSERT_FIELDS, "links").alias("new")))["new"].alias("new"),
            F.max(F.when(F.col("id").isNotNull(), F.struct("seq", "id")))["id"].alias("given"),
        )
    )
    # Columns, not one struct, so that each reader takes only what it needs.
    last = last.select("source_folder", "given", F.lit(True).alias("_new"), *[F.col(f"new.{f}").alias(f"new_{f}") for f in [*UPSERT_FIELDS, "links"]])
    last = cut(last) if stored else last
    made_id = stable_id("challenge", "source_folder") if new_id is None else new_id
    fresh = F.col("_new").isNotNull()
    old = challenges.withColumnRenamed("id", "old_id")
    both = old.join(last, "source_folder", "full").withColumn("id", F.coalesce("given", "old_id", made_id))
    columns = {f: F.when(fresh, F.col(f"new_{f}")).otherwise(F.col(f)) for f in UPSERT_FIELDS}
    columns["solve_count"] = F.coalesce("solve_count", F.lit(0))
    columns["inserted_at"] = F.coalesce("inserted_at", stamp(now))
    columns["updated_at"] = F.when(fresh, stamp(now)).otherwise(F.col("updated_at"))
    merged = both.withColumns(columns)
    if unique:
        after = challenges.select("source_folder", F.col("id").alias("old_id"), "name").join(last, "source_folder", "full")
        after = after.select(
            F.coalesce("given", "old_id", made_id).alias("id"), F.coalesce("new_name", "name").alias("name"), fresh.alias("_wrote")
        )
        written = last.select(F.coalesce("given", made_id).alias("id"), F.col("new_name").alias("name"))
        merged = unless_clashes(merged, change_duplicates(after, written, "challenges"), "challenges")
    lists = merged.where(fresh).select(F.col("id").alias("challenge_id"), F.col("new_links").alias("links"))
    return merged.select(*challenges.columns), lists, judged
