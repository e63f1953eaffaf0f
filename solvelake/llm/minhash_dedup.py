"""Near duplicates: min-hash signatures, joined by Hamming distance through an index of chunks with allowed errors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvelake.llm.base import row_key, store, told
from solvelake.llm.components import components
from solvelake.llm.hashing import U, grams, mix, span_hashes, text_pieces, word_spans
from solvelake.operators.joins import split_join


@dataclass(frozen=True)
class Index:
    """A signature has ``chunks`` * ``width`` symbols of 16 bits, one per min-hash.

    Two signatures that differ in fewer than 2 * ``chunks`` symbols have, by the pigeonhole principle, a chunk with at
    most one differing symbol. So every signature is filed under each chunk with each one symbol left out, and all
    such pairs meet. Pairs that meet are checked on their full sets if they differ in at most ``max_distance``
    symbols, and in ``max_finer`` of the ``finer`` symbols of their sketches.
    """

    chunks: int
    width: int
    max_distance: int
    finer: int = 512
    max_finer: int = 512
    block: int = 512

    @property
    def symbols(self) -> int:
        return self.chunks * self.width


def index_for(percent: int, width: int = 6) -> Index:
    """So many chunks that a pair just at the similarity meets in none in one of ten million cases, and distances that
    such a pair exceeds as rarely, by the exact binomial tail.

    At 85 %: 11 chunks; such pairs differ in 10 of 66 symbols on average, and none within 21 are lost.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is 50 to 100")
    j = percent / 100
    apart = 1 - j**width - width * (1 - j) * j ** (width - 1)
    chunks = max(2, math.ceil(math.log(1e-7) / math.log(apart))) if apart > 0 else 2
    n = chunks * width
    return Index(chunks, width, _most(n, 1 - j), 512, _most(512, 1 - j))


def _most(n: int, p: float, rare: float = 1e-7) -> int:
    """The least number that a binomial variable of ``n`` trials exceeds with probability ``rare`` at most."""
    most, tail = n, 0.0
    while most and (tail := tail + math.comb(n, most) * p**most * (1 - p) ** (n - most)) <= rare:
        most -= 1
    return most


def _seeds(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (
        rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32),
        rng.integers(0, 2**31, n, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1),
    )


def _min_hashes(shingles: np.ndarray, n: int, seed: int) -> np.ndarray:
    flips, factors = _seeds(n, seed)
    low = np.full(n, 2**32 - 1, np.uint32)
    parts = (shingles >> U(32)).astype(np.uint32)
    for at in range(0, len(parts), 1024):
        np.minimum(low, ((parts[at : at + 1024, None] ^ flips) * factors).min(axis=0), out=low)
    return low * np.uint32(0x9E3779B1)


def signature(shingles: np.ndarray, index: Index) -> bytes:
    return (_min_hashes(shingles, index.symbols, 7919) >> np.uint32(16)).astype("<u2").tobytes()


def sketch(shingles: np.ndarray, index: Index) -> bytes:
    """Further min-hashes, of 8 bits, that tell a pair's similarity more closely than its signatures."""
    return (_min_hashes(shingles, index.finer, 104729) >> np.uint32(24)).astype(np.uint8).tobytes()


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text: words lower-cased in A-Z, all of them if fewer than ``size``."""
    for _, offsets, data in text_pieces(column):
        starts, ends, first = word_spans(data, offsets)
        words = span_hashes(data, starts, ends, lower=True)
        runs = grams(words, size)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            else:
                yield grams(words[a:b], b - a) if b > a else np.zeros(0, U)


def signatures(docs: DataFrame, size: int, index: Index) -> DataFrame:
    """``doc_id``, ``n_shingles``, a 128-bit fingerprint of the set, and the signature (null for an empty set)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, sig = [], [], [], []
            for s in shingle_sets(batch.column("text"), size):
                n.append(len(s))
                one.append(int(s.sum(dtype=U).view(np.int64)))
                two.append(int(mix(s).sum(dtype=U).view(np.int64)))
                sig.append(signature(s, index) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, one, two)], pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "f1", "f2", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, f1 long, f2 long, sig binary")


def _symbols(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<u2") for x in column.to_pylist()])


def _keys(symbols: np.ndarray, index: Index) -> np.ndarray:
    """Rows x chunks x left-out symbol: the key of each chunk without that symbol."""
    chunks, width = index.chunks, index.width
    parts = symbols.reshape(-1, chunks, width).astype(U) + U(1)
    keys = np.empty(parts.shape, U)
    for gap in range(width):
        acc = np.broadcast_to((np.arange(chunks) * width + gap).astype(U), parts.shape[:2]).copy()
        for k in range(width):
            if k != gap:
                acc = acc * U(0xD6E8FEB86659FD93) + parts[:, :, k]
        keys[:, :, gap] = mix(acc)
    return keys


def _first_slot(left: np.ndarray, right: np.ndarray, index: Index) -> np.ndarray:
    """For pairs of signatures, the first of the slots (chunk * width + left-out symbol) in which they meet."""
    differ = (left != right).reshape(-1, index.chunks, index.width)
    chunk = (differ.sum(axis=2) <= 1).argmax(axis=1)
    return chunk * index.width + differ[np.arange(len(differ)), chunk].argmax(axis=1)


def chunk_keys(classes: DataFrame, index: Index) -> DataFrame:
    """(``key``, ``rep``): each signature under each chunk with each one symbol left out."""
    kind = dict(classes.dtypes)["rep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(_symbols(batch.column("sig")), index)
            rep = batch.column("rep").take(pa.array(np.repeat(np.arange(len(keys)), index.symbols)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), rep], names=["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, f"key long, rep {kind}")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of ids whose full sets have 100 * shared >= ``percent`` * together.

    Sets are made again, for documents that are in a pair only.
    """
    kind = dict(pairs.dtypes)["a"]
    wanted = told(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"]
            )

    sets, _ = store(
        docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(run, f"id {kind}, shingles array<long>"),
        "sets",
    )
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    checked = both.select("a", "b", shared.alias("s"), (F.size("set_a") + F.size("set_b")).alias("t"))
    return checked.filter(100 * F.col("s") >= percent * (F.col("t") - F.col("s"))).select("a", "b").distinct()


def _sketched(docs: DataFrame, reps: DataFrame, size: int, index: Index) -> DataFrame:
    kind = dict(reps.dtypes)["rep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [sketch(s, index) for s in shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sketches, pa.binary())], names=["rep", "sketch"])

    wanted = told(reps.withColumnRenamed("rep", "doc_id"))
    return docs.join(wanted, "doc_id", "left_semi").mapInArrow(run, f"rep {kind}, sketch binary")


def _unsettled(
    buckets: DataFrame, found: DataFrame, classes: DataFrame, docs: DataFrame, size: int, index: Index
) -> DataFrame:
    """Pairs that meet in the index, are in different components by now, and are near by signature and sketch.

    A pair that meets in many buckets counts in the first of them only. A large bucket is dealt into blocks, and each
    two blocks meet in a group of their own, so no group grows with its bucket.
    """
    kind = dict(classes.dtypes)["rep"]
    names = found.select(F.col("id").alias("rep"), "component")
    rest = buckets.select("key", "rep").join(names, "rep", "left")
    rest, _ = store(rest.select("key", "rep", F.coalesce("component", "rep").alias("component")), "rest")
    mixed = (
        rest.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
        .filter("low <> high")
        .select("key", "n")
    )
    open_, _ = store(split_join(rest, mixed, ["key"], "inner"), "open")
    sketches = _sketched(docs, open_.select("rep").distinct(), size, index)
    known = classes.select("rep", "sig").join(sketches, "rep").dropDuplicates(["rep"])
    rows = open_.join(known, "rep")
    blocks = F.ceil(F.col("n") / index.block).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select(
        "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        (F.col("own") <= F.col("other")).alias("first"), "rep", "component", "sig", "sketch",
    )

    def compare(group: pa.Table) -> pa.Table:
        sig = _symbols(group.column("sig"))
        fine = np.stack([np.frombuffer(x, np.uint8) for x in group.column("sketch").to_pylist()])
        slot = int((_keys(sig[:1], index).reshape(-1).view(np.int64) == group.column("key")[0].as_py()).argmax())
        _, component = np.unique(group.column("component").to_numpy(), return_inverse=True)
        first = group.column("first").to_numpy()
        same = group.column("x")[0].as_py() == group.column("y")[0].as_py()
        everywhere = np.arange(len(sig))
        # Of a pair across components, one member at least is outside the largest component.
        largest = np.bincount(component).argmax()
        a, b = [], []
        for i in np.flatnonzero(component != largest).tolist():
            right = everywhere if same else np.flatnonzero(first != first[i])
            right = right[(component[right] != component[i]) & ((component[right] == largest) | (right > i))]
            right = right[(sig[right] != sig[i]).sum(axis=1) <= index.max_distance]
            right = right[(fine[right] != fine[i]).sum(axis=1) <= index.max_finer]
            if len(right):
                right = right[_first_slot(sig[right], np.broadcast_to(sig[i], (len(right), index.symbols)), index) == slot]
            b.append(right)
            a.append(np.full(len(right), i))
        reps = group.column("rep").combine_chunks()
        at = lambda x: reps.take(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))
        return pa.table({"a": at(a), "b": at(b)})

    pairs = rows.groupBy("key", "x", "y").applyInArrow(compare, f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, percent: int = 80, size: int = 5, index: Index | None = None, firsts: int = 5
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents whose sets of ``size``-word shingles have ``percent`` of all their shingles in common are linked; a
    component is what links reach, named by its smallest doc_id, which alone is kept. Texts with fewer words have one
    shingle of all; null and empty texts have none and link with nothing. Rows with one doc_id are one document. Rows
    without a doc_id have a null component and are kept.

    Equal sets are one class from the start, so copies cost one row each. Classes meet in the index (see ``Index``).
    Round one confirms each class against the ``firsts`` bucket leaders that it meets most often. Round two compares
    members of one bucket where they are still in different components, so a group of near copies is not expanded
    into its pairs.
    """
    index = index or index_for(percent)
    docs = docs.select("doc_id", "text")
    signed, _ = store(signatures(docs, size, index), "signed")
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    classes, _ = store(
        usable.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes"
    )
    keys = chunk_keys(classes, index)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).filter("n > 1").drop("n")
    buckets, _ = store(split_join(keys, shared, ["key"], "inner"), "buckets")
    met = buckets.filter("rep <> pivot").groupBy("rep", "pivot").agg((-F.count(F.lit(1))).alias("n"))
    often = F.slice(F.sort_array(F.collect_list(F.struct("n", "pivot"))), 1, firsts)  # of one per key of a class at most
    stars = met.groupBy("rep").agg(often.alias("p")).select(F.explode("p.pivot").alias("a"), F.col("rep").alias("b"))
    first, _ = store(confirmed(stars, docs, size, percent), "links")
    rest, _ = store(_unsettled(buckets, components(first), classes, docs, size, index), "rest-pairs")
    second, _ = store(confirmed(rest, docs, size, percent), "links")
    copies = (
        usable.join(classes.select("n_shingles", "f1", "f2", "rep"), ["n_shingles", "f1", "f2"])
        .filter("doc_id <> rep")
        .select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    )
    found = components(first.union(second).union(copies)).withColumnRenamed("id", "doc_id")
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"),
    )


def _least_row() -> Column:
    """Of rows with one id and text the first by all its columns, so that a repeated task keeps the same one."""
    return F.min_by("_row", F.to_json("_row")).alias("_row")


def keep_one(docs: DataFrame, percent: int = 80, size: int = 5, index: Index | None = None) -> DataFrame:
    """One row, with its own columns, for each component's smallest document and each text under its id.

    A row without a doc_id goes if its set equals that of a row with one, or that of another row without one, of which
    a single row stays. Rows without a doc_id whose set is empty stay, as they link with nothing.
    """
    tk = row_key(F.col("text"))
    gone = near_duplicates(docs, percent, size, index).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), tk.alias("_tk"))
    named = rows.filter("_id is not null").join(told(gone.distinct()), F.col("_id") == F.col("_gone"), "left_anti")
    # Only rows that are repeated are brought together; the other texts are not shuffled.
    keys = docs.filter("doc_id is not null").select(F.col("doc_id").alias("_i"), tk.alias("_t"))
    repeated = told(keys.groupBy("_i", "_t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    same = (F.col("_id") == F.col("_i")) & (F.col("_tk") == F.col("_t"))
    once = named.join(repeated, same, "left_semi").groupBy("_id", "_tk").agg(_least_row())
    kept = named.join(repeated, same, "left_anti").select("_row").union(once.select("_row"))
    return kept.union(_without_id(docs, rows.filter("_id is null"), size, index or index_for(percent))).select("_row.*")


def _without_id(docs: DataFrame, rows: DataFrame, size: int, index: Index) -> DataFrame:
    """The ``rows`` without a doc_id that stay (see ``keep_one``)."""
    mark = ["n_shingles", "f1", "f2"]
    nameless = docs.filter("doc_id is null").select(row_key(F.col("text")).alias("doc_id"), "text")
    sets, _ = store(signatures(nameless, size, index).select(F.col("doc_id").alias("_t"), *mark), "nameless")
    if sets.isEmpty():
        return rows.select("_row")
    full = sets.filter("n_shingles > 0")
    known = signatures(docs.filter("doc_id is not null"), size, index).select(*mark)
    first = full.groupBy(*mark).agg(F.min("_t").alias("_t")).join(known, mark, "left_anti").select("_t")
    once = rows.join(told(first), F.col("_tk") == F.col("_t"), "left_semi").groupBy("_tk").agg(_least_row())
    empty = told(sets.filter("n_shingles = 0").select("_t").distinct())
    return once.select("_row").union(rows.join(empty, F.col("_tk") == F.col("_t"), "left_semi").select("_row"))
