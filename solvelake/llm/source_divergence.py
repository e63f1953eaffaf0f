"""How the sources of a language differ in their terms: exact counts in the slots of broadcast perfect hashes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvelake.llm import perfect_hash
from solvelake.llm.base import discard, store

#: Terms in a shard, on average; shards are told to tasks until they have so many bytes, the others in later passes.
SHARD, TOLD = 1 << 14, 48 << 20
#: Entries that a task holds before it hands them on or forgets them, terms that it looks up together, slots that it
#: holds, and bytes of text that it splits at a time.
ENTRIES, TERMS, SLOTS, SPLIT = 1 << 18, 1 << 20, 1 << 22, 1 << 22

#: Bytes of terms: A-Z as a-z, other ASCII characters than letters as spaces.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size: runs of letters and of characters beyond ASCII."""
    folded, at = raw.translate(FOLD), 0
    while len(folded) - at > SPLIT:
        end = folded.rfind(b" ", at, at + SPLIT) + 1 or folded.find(b" ", at + SPLIT) + 1 or len(folded)
        yield folded[at:end].split()
        at = end
    yield folded[at:].split()


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    kept = [batch.column(c).cast(pa.large_binary()).fill_null(b"") for c in columns]
    for row in zip(*kept, strict=True):
        yield tuple(x.as_buffer().to_pybytes() for x in row)


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """``lang``, ``term``: terms that stand in ``min_docs`` documents of the language or more, counted exactly."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, term, n) for lang, counts in held.items() for term, n in counts.items()]
            held.clear()
            lang, term, n = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.binary()).cast(pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
                names=["lang", "term", "n"],
            )

        for batch in batches:
            for lang, text in _rows(batch, "lang", "text"):
                held.setdefault(lang, Counter()).update({t for part in terms(text) for t in part})
            if sum(map(len, held.values())) > ENTRIES:
                yield flush()
        yield flush()

    counts = docs.select("lang", "text").mapInArrow(pages, "lang string, term string, n long")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")


def _key(lang: Column, term: Column) -> Column:
    """One name for a term of a language: no term has a zero byte."""
    return F.concat(F.encode(lang, "UTF-8"), F.lit(b"\0"), F.encode(term, "UTF-8"))


def sharded(kept: DataFrame, shards: int) -> DataFrame:
    """``shard``, ``n``, ``size``, ``data``: a perfect hash for each part of the kept terms."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys = None, []
        for batch in batches:
            shard = batch.column("shard")[0].as_py()
            keys += batch.column("key").to_pylist()
        data = perfect_hash.dump(perfect_hash.build(sorted(keys)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data])],
            names=["shard", "n", "size", "data"],
        )

    key = _key(F.col("lang"), F.col("term"))
    return (
        kept.select(key.alias("key"))
        .withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInArrow(build, "shard int, n long, size long, data binary")
    )


def names(tables: DataFrame) -> DataFrame:
    """``id`` (shard and slot), ``lang``, ``term`` of every kept term, read from the stored keys."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist(), strict=True):
                table = perfect_hash.load(data)
                lang, _, term = zip(*(table.key(k).rpartition(b"\0") for k in range(len(table))), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((shard << 32) + np.arange(len(table))),
                        pa.array(lang, pa.binary()).cast(pa.string()),
                        pa.array(term, pa.binary()).cast(pa.string()),
                    ],
                    names=["id", "lang", "term"],
                )

    return tables.select("shard", "data").mapInArrow(listed, "id long, lang string, term string")


def recount(docs: DataFrame, tables: DataFrame, shards: int) -> DataFrame:
    """``lang``, ``source``, ``id``, ``n``: occurrences of kept terms in each group, where there are any.

    Tasks get the perfect hashes, look the terms of their texts up, and add to an array of slots per group and shard;
    what they hand on is summed. A term that was looked up lately is remembered with its slot. If the hashes have more than ``TOLD`` bytes, the texts are read once for each so many.
    """
    spark = docs.sparkSession
    passes: list[list[int]] = []
    room = 0
    for row in tables.select("shard", "size").orderBy("shard").collect():
        if row["size"] > room:
            passes.append([])
            room = TOLD
        passes[-1].append(row["shard"])
        room -= row["size"]

    def counted(chosen: list[int]) -> tuple[DataFrame, str]:
        rows = tables.filter(F.col("shard").isin(chosen)).select("shard", "data").collect()
        told = spark.sparkContext.broadcast({r["shard"]: bytes(r["data"]) for r in rows})

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = {shard: perfect_hash.load(data) for shard, data in told.value.items()}
            places: dict[bytes, dict[bytes, int]] = {}  # by language: the id of a term, -1 for those without a slot
            held: dict[tuple[bytes, bytes], list[bytes]] = {}
            slots: dict[tuple[bytes, bytes, int], np.ndarray] = {}

            def learn(lang: bytes, new: list[bytes]) -> None:
                keys = [lang + b"\0" + term for term in new]
                hashed = perfect_hash.hash_keys(keys)
                shard = hashed.view(np.int64) % shards
                ids = np.full(len(keys), -1)
                for k in np.unique(shard).tolist():
                    if k in hashes:
                        own = np.flatnonzero(shard == k)
                        slot = hashes[k].slots([keys[i] for i in own.tolist()], hashed[own])
                        ids[own] = np.where(slot < 0, -1, k << 32 | slot)
                places[lang].update(zip(new, ids.tolist(), strict=True))

            def settle() -> None:
                counted = {group: Counter(found) for group, found in held.items()}
                for lang in {lang for lang, _ in counted}:
                    place = places.setdefault(lang, {})
                    if len(place) > ENTRIES:
                        place.clear()
                    learn(lang, list(set().union(*(c for g, c in counted.items() if g[0] == lang)).difference(place)))
                for (lang, source), counts in counted.items():
                    ids = np.fromiter(map(places[lang].__getitem__, counts), np.int64, len(counts))
                    n = np.fromiter(counts.values(), np.int64, len(counts))[ids >= 0]
                    ids = ids[ids >= 0]
                    shard, slot = ids >> 32, ids & 0xFFFFFFFF
                    for k in np.unique(shard).tolist():
                        name = (lang, source, k)
                        if name not in slots:
                            slots[name] = np.zeros(len(hashes[k]), np.int64)
                        slots[name][slot[shard == k]] += n[shard == k]
                held.clear()

            def flush() -> Iterator[pa.RecordBatch]:
                for (lang, source, shard), array in slots.items():
                    some = np.flatnonzero(array)
                    group = [pa.repeat(pa.scalar(x.decode()), len(some)) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays(
                        [*group, pa.array((shard << 32) + some), pa.array(array[some])], names=["lang", "source", "id", "n"]
                    )
                slots.clear()

            n = 0
            for batch in batches:
                for lang, source, text in _rows(batch, "lang", "source", "text"):
                    for part in terms(text):
                        held.setdefault((lang, source), []).extend(part)
                        n += len(part)
                        if n > TERMS:
                            settle()
                            n = 0
                            if sum(map(len, slots.values())) > SLOTS:
                                yield from flush()
            settle()
            yield from flush()

        cells = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, id long, n long")
        out = store(cells.groupBy("lang", "source", "id").agg(F.sum("n").alias("n")), "cells")
        told.destroy()
        return out

    out = None
    for chosen in passes:
        cells, _ = counted(chosen)
        out = cells if out is None else out.union(cells)
    return spark.createDataFrame([], "lang string, source string, id long, n long") if out is None else out


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * size)), exact in 64 bits while the divisor is below 9 * 10^15."""
    out, rest, over = F.lit(0).cast("long"), count + 5, total + 5 * size
    for _ in range(3):
        out, rest = out * 1000 + F.call_function("div", rest * 1000, over), rest * 1000 % over
    return out + 1


def _shares(count: np.ndarray, over: np.ndarray) -> np.ndarray:
    """The same over arrays."""
    out, rest = np.zeros(np.broadcast(count, over).shape, np.int64), count + 5
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // over, rest % over
    return out + 1


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of all pairs of sources over the terms of one block."""
    table = pa.Table.from_batches(list(batches))
    lang, size = table.column("lang")[0], table.column("size")[0].as_py()
    totals = table.filter(table.column("id").is_null())
    cells = table.filter(table.column("id").is_valid())
    by_name = sorted(zip(totals.column("source").to_pylist(), totals.column("n").to_pylist(), strict=True))
    number = {name: k for k, (name, _) in enumerate(by_name)}
    sources = list(number)
    over = np.maximum(np.array([n for _, n in by_name], np.int64) + 5 * size, 1)
    ids, column = np.unique(cells.column("id").to_numpy(), return_inverse=True)
    row = np.fromiter(map(number.__getitem__, cells.column("source").to_pylist()), np.int64, len(column))
    shares = np.repeat(_shares(np.zeros(len(over), np.int64), over)[:, None], len(ids), axis=1)
    shares[row, column] = _shares(cells.column("n").to_numpy(), over[row])
    for k in range(len(sources) - 1):
        apart = np.abs(shares[k + 1 :] - shares[k]).sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang.as_py()] * len(apart), pa.string()), pa.array([sources[k]] * len(apart), pa.string()),
                pa.array(sources[k + 1 :], pa.string()), pa.array(apart, pa.int64()),
            ],
            names=["lang", "a", "b", "value"],
        )


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how each source of a language differs.

    Terms are runs of ASCII letters (A-Z as a-z) and of characters beyond ASCII; a language keeps those that stand in
    ``min_docs`` of its documents. A group, (lang, source), or a language gives a kept term the share p, in parts of
    10^9 (see ``share``). Part ``pair``: for each other source of the language the sum of the differences of all
    shares. Part ``term``: up to ``top`` terms of the group whose share exceeds the language's, and by how much.

    Null ``lang``, ``source`` and texts count as ''. A group without terms has pairs like the others, and no terms;
    without kept terms all distances are 0; a language of one source has no pairs. Repeated rows count as often as
    they stand; further columns are not read; an empty table gives no rows.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    spark = docs.sparkSession
    kept, kept_path = store(kept_terms(docs, min_docs), "kept")
    shards = -(-kept.count() // SHARD)
    tables, tables_path = store(sharded(kept, shards), "perfect") if shards else (None, None)
    if shards:
        cells = recount(docs, tables, shards)
        named, _ = store(names(tables), "terms")
        discard(spark, tables_path)
    else:
        cells = spark.createDataFrame([], "lang string, source string, id long, n long")
        named = spark.createDataFrame([], "id long, lang string, term string")
    sizes = named.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups, _ = store(groups.fillna(0, ["total", "size"]), "groups")
    discard(spark, kept_path)
    langs = groups.groupBy("lang").agg(
        F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("sources"), F.first("size").alias("lang_size")
    )

    # Blocks of terms: as many cells as pairs of sources at least, so that no block makes more rows than it reads.
    width = F.least(F.greatest(F.lit(1 << 16), F.col("sources") * F.col("sources")), F.lit(1 << 22)) / F.col("sources")
    blocks = langs.select("lang", F.greatest(F.lit(1), F.ceil(F.col("lang_size") / width)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    parts = cells.join(blocks, "lang").join(sizes, "lang").select("lang", block, "source", "id", "n", "size")
    every = groups.join(blocks, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source",
        F.lit(None).cast("long").alias("id"), F.col("total").alias("n"), "size",
    )
    apart = (
        parts.union(every).groupBy("lang", "block")
        .applyInArrow(_distances, "lang string, a string, b string, value long")
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    )
    both = apart.unionAll(apart.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = _ranked(both.toDF("lang", "source", "item", "value"))

    in_lang = cells.groupBy("id").agg(F.sum("n").alias("lang_n"))
    known = cells.join(in_lang, "id").join(groups, ["lang", "source"]).join(langs.select("lang", "lang_total"), "lang")
    p = share(F.col("n"), F.col("total"), F.col("size"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("size"))
    above = known.withColumn("value", p - q).filter("value > 0")
    above = above.join(named.select("id", F.col("term").alias("item")), "id").select("lang", "source", "item", "value")
    best = _ranked(above).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("part", F.lit("pair")).select(*columns)
        .unionAll(best.withColumn("part", F.lit("term")).select(*columns))
    )
