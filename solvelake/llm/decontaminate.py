"""Benchmark decontamination: training documents against the word windows of test items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvelake.llm.base import let, lower_ascii, row_key, store, told, windows

#: What separates words once A-Z is lower-cased: ASCII other than digits and a-z.
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS), "")


#: Windows whose hashes go to the tasks at a time, and hashes in a bucket of their table.
PER_PASS, PER_BUCKET = 500_000, 4


def benchmark_windows(benchmark: DataFrame, size: int = 13) -> DataFrame:
    """``gram`` (words joined by a space), ``len`` and the ``items`` that hold it.

    An item with fewer than ``size`` words, but not none, is one window. Items without an id are numbered by no one:
    their windows count without an item.
    """
    words = benchmark.select("item_id", item_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    grams = F.when(F.size("w") < size, F.array(F.array_join("w", " "))).otherwise(
        windows(F.col("w"), size, lambda s: F.array_join(s, " "))
    )
    rows = words.select("item_id", F.least(F.size("w"), F.lit(size)).alias("len"), F.explode(grams).alias("gram"))
    return rows.groupBy("gram", "len").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def _table(hashes: DataFrame, buckets: int) -> Column:
    """The hashes (column ``h``) as one hash set: a constant array of ``buckets`` short arrays.

    It comes to the driver as one text of some 20 bytes a hash, and goes to the tasks with the plan.
    """
    filled = hashes.groupBy(F.pmod("h", F.lit(buckets)).alias("b")).agg(F.collect_list("h").alias("hs"))
    every = hashes.sparkSession.range(buckets).select(F.col("id").alias("b")).join(filled, "b", "left")
    none = F.array().cast("array<bigint>")
    rows = F.sort_array(F.collect_list(F.struct("b", F.coalesce("hs", none).alias("hs"))))
    return F.from_json(F.lit(every.agg(F.to_json(rows.getField("hs"))).first()[0]), "array<array<bigint>>")


def scan(docs: DataFrame, grams: DataFrame, lens: list[int], per_pass: int = PER_PASS) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``key`` and ``n_words`` of every row, and every place (``doc_id``, ``key``, ``pos``, ``len``,
    ``gram``) whose words have the hash of a benchmark window.

    Each window of a text is looked up in a hash set of 64-bit hashes and only found ones leave the row, so texts are
    never shuffled, whatever the size of the benchmark. Beyond ``per_pass`` windows the set is told in shares, one
    pass over the texts each.
    """
    found = "array<struct<pos:int,len:int,gram:string>>"
    hashes, _ = store(grams.select(F.xxhash64(F.split("gram", " ")).alias("h")).distinct(), "hashes")
    count = hashes.count()
    passes = max(1, -(-count // max(1, per_pass)))
    buckets = max(1, count // passes // PER_BUCKET)

    def places(words: Column, table: Column, n: int) -> Column:
        seen = F.transform(
            windows(words, n), lambda h, i: F.when(F.array_contains(F.get(table, F.pmod(h, F.lit(buckets)).cast("int")), h), i + 1)
        )
        return F.transform(
            F.array_compact(seen),
            lambda p: F.struct(p.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice(words, p, n), " ").alias("gram")),
        )

    def row(words: Column, table: Column) -> Column:
        at = F.flatten(F.array(*[places(words, table, n) for n in lens])) if lens else F.array().cast(found)
        return F.struct(F.size(words).cast("long").alias("n"), at.alias("at"))

    steps = []
    for share in range(passes):
        table = _table(hashes.filter(F.pmod(F.xxhash64("h"), F.lit(passes)) == share), buckets)  # of about ``per_pass``
        of_row = let(table, lambda t: let(item_words(F.col("text")), lambda w: row(w, t)))  # noqa: B023
        rows = docs.select("doc_id", row_key(F.col("text")).alias("key"), of_row.alias("_of"))
        out = rows.select("doc_id", "key", F.col("_of.n").alias("n_words"), F.col("_of.at").alias("at"))
        steps.append(store(out, "scanned")[0])
    met = reduce(DataFrame.union, steps).select("doc_id", "key", F.explode("at").alias("at"))
    return steps[0].select("doc_id", "key", "n_words"), met.select("doc_id", "key", "at.*")


def hits_and_items(places: DataFrame, grams: DataFrame) -> DataFrame:
    """Per document (``doc_id``, ``key``) the places whose words are a benchmark window's, and the items they occur in.

    Hashes that met are verified as text. Items are looked up once for each window of a document, not for each place.
    """
    true = places.join(grams.select("gram"), "gram", "left_semi")
    runs = true.select("doc_id", "key", F.struct("pos", "len").alias("hit"), F.lit(None).cast("string").alias("item"))
    named = true.select("doc_id", "key", "gram").distinct().join(grams.select("gram", "items"), "gram")
    items = named.select(
        "doc_id", "key", F.lit(None).cast("struct<pos:int,len:int>").alias("hit"), F.explode("items").alias("item")
    )
    return (
        runs.unionByName(items)
        .groupBy("doc_id", "key")
        .agg(F.sort_array(F.collect_set("hit")).alias("hits"), F.sort_array(F.collect_set("item")).alias("items"))
    )


def _covered(places: Column) -> Column:
    """Words under ascending (pos, len) runs."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))

    def step(a: Column, x: Column) -> Column:
        end = x["pos"] + x["len"]
        return F.struct(
            (a["total"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["pos"]))).alias("total"),
            F.greatest(a["end"], end).alias("end"),
        )

    return F.aggregate(places, zero, step, lambda a: a["total"].cast("long"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, min_percent: int = 5, set_limit: int = PER_PASS
) -> DataFrame:
    """One row per row of ``docs``: ``n_words``, ``n_hit``, ``items`` (ids as sorted strings), ``hits``,
    ``contaminated`` and ``key`` (of the text).

    A word is hit if it lies inside any occurrence of a benchmark window; a document is contaminated if hit words
    are at least ``min_percent`` of its words. Null and empty texts have no words and no hits; an empty benchmark
    contaminates nothing; equal rows get equal results; rows of one id with different texts are judged apart.
    ``hits`` holds the (pos, len) runs in words, from 1. The set of hashes holds about ``set_limit`` windows at a time.
    """
    grams, _ = store(benchmark_windows(benchmark, size), "grams")
    lens = sorted(r["len"] for r in grams.select("len").distinct().collect())  # at most ``size`` numbers
    base, places = scan(docs, grams, lens, set_limit)
    per_doc = hits_and_items(places, grams).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    base = base.join(per_doc, same, "left").drop("_id", "_key")
    hits = F.coalesce("hits", F.array().cast("array<struct<pos:int,len:int>>"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = base.withColumns({"hits": hits, "items": items}).withColumn("n_hit", _covered(F.col("hits")))
    bad = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= min_percent * F.col("n_words"))
    return out.withColumn("contaminated", bad)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = 13, min_percent: int = 5,
    set_limit: int = PER_PASS,
) -> DataFrame:
    """``docs`` without contaminated documents, or, with ``remove="spans"``, without the hit words in any document.

    Columns are those of ``docs``, whatever their names. A hit word goes together with the characters up to the next
    word.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    verdicts = contamination(docs, benchmark, size, min_percent, set_limit)
    marked = verdicts.filter("contaminated" if remove == "documents" else "n_hit > 0")
    marked = marked.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("hits").alias("_hits"))
    marked = marked.dropDuplicates(["_id", "_key"])
    rows = docs.select(F.struct("*").alias("_row"), row_key(F.col("text")).alias("_k"), F.col("doc_id").alias("_d"))
    same = (F.col("_k") == F.col("_key")) & F.col("_d").eqNullSafe(F.col("_id"))
    if remove == "documents":
        return rows.join(told(marked.select("_id", "_key")), same, "left_anti").select("_row.*")
    joined = rows.join(marked, same, "left")
    segment = "([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*)"
    text = F.col("_row.text")
    hit = F.array_distinct(F.flatten(F.transform("_hits", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1))))
    kept = let(
        hit,
        lambda at: F.array_join(
            F.filter(
                F.regexp_extract_all(text, F.lit(segment), F.lit(1)), lambda x, i: ~F.array_contains(at, i + 1)
            ),
            "",
        ),
    )
    head = F.regexp_extract(text, "^([\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*)", 1)
    clean = F.when(F.col("_hits").isNull(), text).otherwise(F.concat(head, kept))
    return joined.select(
        *[clean.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns]
    )
