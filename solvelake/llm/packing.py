"""Packing of tokenised documents into sequences of one length: shortest pack first, over the length histogram."""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solvelake.llm.base import store

PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def byte_bpe(json_path: str, ranks_path: str, pattern: str, special: dict[str, int]) -> Callable[[list[str]], list]:
    """An encoder with the ids of ``tokenizers`` for the file ``json_path``.

    The same vocabulary as ranks encodes three times as fast, with the same pattern. Both libraries agree on letters
    up to U+024F, whose character classes are the same in every Unicode version; other texts go to ``tokenizers``. So
    do texts that ``tiktoken`` refuses: its pattern gives up on a run of a million white-space characters.
    """
    import base64
    import re

    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    slow = Tokenizer.from_file(json_path)
    rare = re.compile("[^\x00-ɏ]")
    allowed = set(special)

    def ids(text: str) -> np.ndarray:
        if not rare.search(text):
            try:
                return fast.encode_to_numpy(text, allowed_special=allowed)
            except ValueError:
                pass
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return lambda texts: [ids(text) for text in texts]


def public_byte_bpe() -> Callable[[list[str]], list]:
    """The encoder of byte_bpe_50k.json."""
    import public_tokenizers as public

    return byte_bpe(
        public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, {"<|endoftext|>": 50256}
    )


def pieces(
    docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list]], max_length: int = 1024, end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Cut each document's ids, ended by ``end_id``, into pieces of ``max_length`` and a rest.

    ``encoder()`` is called once per task and gives a function from texts to id arrays. Null texts are empty: their
    only id is ``end_id``. ``ids`` holds little-endian 32-bit ids if asked for, else null.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or encoder()
            rows: list[list] = [[], [], [], [], [], []]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id"), encode(texts), strict=True):
                raw = np.append(ids, end_id).astype("<u4")
                for start in range(0, len(raw), max_length):
                    data = raw[start : start + max_length].tobytes()
                    values = (doc, start, len(data) // 4, zlib.crc32(data), len(raw), data if with_ids else None)
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
            doc_ids = pa.array([x.as_py() for x in rows[0]], batch.schema.field("doc_id").type)
            longs = [pa.array(x, pa.int64()) for x in rows[1:5]]
            yield pa.RecordBatch.from_arrays(
                [doc_ids, *longs, pa.array(rows[5], pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES.format(id=kind))


def shortest_pack_first(counts: dict[int, int], max_length: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a sequence, number of such sequences) that hold ``counts[length]`` pieces of each length.

    Lengths go longest first, each into the open pattern with the most room, which may split it in two: the part that
    took the piece and the part that did not. If none has room, a new pattern opens. The number of patterns follows
    from ``max_length``, not from the number of pieces.
    """
    open_: list[tuple[int, int, list[int], int]] = []  # (used, serial, lengths, sequences), shortest pack first
    serial = 0

    def push(lengths: list[int], n: int) -> None:
        nonlocal serial
        serial += 1
        heapq.heappush(open_, (sum(lengths), serial, lengths, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if open_ and open_[0][0] + length <= max_length:
                _, _, lengths, n = heapq.heappop(open_)
                fill = min(left, n)
                push([*lengths, length], fill)
                if fill < n:
                    push(lengths, n - fill)
                left -= fill
            else:  # a new pack is the shortest until it is full
                each = min(max_length // length, left)
                push([length] * each, left // each)
                left %= each
    return [(lengths, n) for _, _, lengths, n in sorted(open_)]


def slots(spark: SparkSession, patterns: list[tuple[list[int], int]]) -> DataFrame:
    """``length``, ranks [``first``, ``last``) of pieces of that length, the sequence of the first, and the offset."""
    rows, rank, sequence = [], {}, 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            first = rank.get(length, 0)
            rows.append((length, first, first + n, sequence, offset))
            rank[length] = first + n
            offset += length
        sequence += n
    return spark.createDataFrame(rows, "length long, first long, last long, sequence long, offset long")


def ranked(table: DataFrame, order: list[str]) -> DataFrame:
    """``table`` with ``rank`` from 0 among the rows of each ``length``.

    A length may be that of most rows, so ranks are counted in blocks (by the hash of ``order``) and moved on by the
    sizes of the blocks before. There are as many blocks as the square root of the rows: neither a block nor the list
    of the blocks of one length grows faster.
    """
    block = F.pmod(F.xxhash64(*order), F.lit(max(1, math.isqrt(table.count()))))
    blocks = table.withColumn("_block", block)
    sizes = blocks.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_block").orderBy(*order)
    placed = blocks.withColumn("_at", F.row_number().over(inside) - 1)
    return (
        placed.join(offsets, ["length", "_block"])
        .withColumn("rank", F.col("_before") + F.col("_at"))
        .drop("_block", "_before", "_at")
    )


def pack(table: DataFrame, max_length: int = 1024) -> DataFrame:
    """Place stored pieces (``doc_id``, ``start``, ``length``, ...) into sequences: adds ``sequence_id``, ``offset``.

    Only the histogram, ``max_length`` numbers at most, comes to the driver; the slots that go to every task are
    bounded by ``max_length`` too. Equal pieces rank in any order, each in its own place. An empty table packs into
    nothing.
    """
    spark = table.sparkSession
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = slots(spark, shortest_pack_first(histogram, max_length)).withColumnRenamed("length", "_length")
    numbered = ranked(table, ["doc_id", "start", "ids_crc32"])
    fits = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    return (
        numbered.join(F.broadcast(places), fits)
        .withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first"))
        .drop("_length", "first", "last", "sequence", "rank")
    )


def pack_documents(
    docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list]] = public_byte_bpe, max_length: int = 1024,
    end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """Pieces of all ``docs`` with their sequence and offset; see ``pieces`` and ``pack``.

    Rows whose doc_id is null or repeated are documents of their own.
    """
    table, _ = store(pieces(docs, encoder, max_length, end_id, with_ids), "pieces")
    return pack(table, max_length)


def padding(lengths: Iterator[int], max_length: int = 1024) -> int:
    """Pad ids that sequences of these lengths need: up to ``max_length``, none at a power of two."""
    return sum(0 if n & (n - 1) == 0 else max_length - n for n in lengths)
