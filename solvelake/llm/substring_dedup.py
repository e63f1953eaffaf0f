"""Repeated word windows across documents, found from anchors at the positions of a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvelake.llm.base import row_key, words_of
from solvelake.llm.hashing import grams, span_hashes, text_pieces, word_spans
from solvelake.llm.repeats import beside_answers, marked, named, runs_of, unpack, with_answers

#: Every difference modulo 7 is one of two members: any two positions have the same offset, under 7, to members.
PERIOD, COVER = 7, (0, 1, 3)


def _word_hashes(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each row and the end) for pieces of a batch."""
    for row, offsets, data in text_pieces(batch.column("text")):
        starts, ends, first = word_spans(data, offsets)
        yield row, span_hashes(data, starts, ends), first


def _anchors(window: int):
    """Hashes of short runs at cover positions; ``ext``: long enough to hold all windows up to the next such anchor."""
    short, long = window - PERIOD + 1, window + PERIOD - 1

    def find(batch: pa.RecordBatch):
        for row, words, first in _word_hashes(batch):
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            place = np.arange(len(words)) - first[doc]
            left = first[doc + 1] - np.arange(len(words))
            at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (left >= window - PERIOD + 1))
            if not len(at):
                continue
            key, ext = grams(words, short), grams(words, long)
            has = left[at] >= long
            longer = np.zeros(len(at), np.uint64)
            longer[has] = ext[at[has]]
            yield doc[at] + row, place[at], key[at], longer, has

    return find


def _settled(n: int, window: int, marks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows (by start) known to be repeated from a smaller document, and those that may be."""
    place, later = unpack(marks)
    long = PERIOD - 1
    count = max(0, n - window + 1)
    known, near = np.zeros(count, bool), np.zeros(count + PERIOD, np.int32)
    for k in range(long + 1):
        at = place[later] + k
        known[at[at < count]] = True
    np.add.at(near, np.clip(place - long, 0, count), 1)
    np.subtract.at(near, np.clip(place + 1, 0, count + PERIOD - 1), 1)
    return known, (np.cumsum(near)[:count] > 0) & ~known


def repeated_windows(docs: DataFrame, window: int = 13) -> DataFrame:
    """Stored ``doc_id``, ``tk``, ``text``, ``marks``, ``more`` of documents that may repeat a window of another.

    Anchors of ``window`` - 6 words at positions 0, 1 and 3 modulo 7 meet at an aligned pair inside any window that
    two documents share. An anchor whose ``window`` + 6 words stand in a smaller document settles the seven windows
    from it on (``marks``). The windows around other shared anchors, which are those at the ends of repeated passages
    and in the smallest documents, are compared one by one (``more``). The smallest document of a window is never
    settled by an anchor, so none is missed.
    """
    held, _ = with_answers(named(docs), marked(named(docs), _anchors(window), False), "marks")

    def find(batch: pa.RecordBatch):
        marks = batch.column("marks").to_pylist()
        for row, words, first in _word_hashes(batch):
            whole = grams(words, window)
            rows, places = [], []
            for d in range(len(first) - 1):
                _, maybe = _settled(int(first[d + 1] - first[d]), window, marks[row + d])
                at = np.flatnonzero(maybe)
                rows.append(np.full(len(at), d))
                places.append(at)
            doc, place = np.concatenate(rows), np.concatenate(places)
            if len(doc):
                key = whole[first[doc] + place]
                yield doc + row, place, key, key >> np.uint64(32), np.ones(len(key), bool)

    return beside_answers(held, marked(held, find, False), "more")


def kept_words(text: bytes, window: int, marks: bytes, more: bytes | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many go."""
    words = text.split()
    repeated, _ = _settled(len(words), window, marks)
    place, later = unpack(more)
    repeated[place[later]] = True
    if not repeated.any():
        return words, 0
    gone = runs_of(repeated, window)
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def substring_dedup(docs: DataFrame, window: int = 13, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined
    by a space) and, if asked for, that ``text`` itself.

    A word goes if a window of ``window`` consecutive words over it also starts in a document with a smaller doc_id,
    whatever goes there. Null and empty texts have no words. Rows of one doc_id are not smaller than one another;
    equal rows get equal results. Rows without a doc_id stay whole and are no source. Windows are compared by hashes
    of 64 bits or more. A doc_id that is no whole number is refused with a TypeError.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words or more")
    held = repeated_windows(docs, window)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for text, marks, more in zip(texts, batch.column("marks").to_pylist(), batch.column("more").to_pylist(), strict=True):
                words, gone = kept_words(text, window, marks, more)
                rows.append((gone, b" ".join(words)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("tk"), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()),
                    pa.array([r[1].decode() if with_text else None for r in rows], pa.string()),
                ],
                names=["_d", "_t", "_n", "_sha", "_text"],
            )

    removed = held.mapInArrow(remove, "_d long, _t long, _n long, _sha string, _text string")
    removed = removed.filter("_n > 0").dropDuplicates(["_d", "_t"])
    plain = F.array_join(F.col("_w"), " ")
    base = docs.select("doc_id", row_key(F.col("text")).alias("tk"), words_of(F.col("text")).alias("_w")).select(
        "doc_id", "tk", F.size("_w").cast("long").alias("n_words"), F.sha2(plain.cast("binary"), 256).alias("sha"),
        (plain if with_text else F.lit(None).cast("string")).alias("plain"),
    )
    joined = base.join(removed, (F.col("doc_id") == F.col("_d")) & (F.col("tk") == F.col("_t")), "left")
    columns = [
        "doc_id", "n_words", F.coalesce("_n", F.lit(0)).alias("n_removed"),
        F.coalesce("_sha", "sha").alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(F.col("_n").isNull(), F.col("plain")).otherwise(F.col("_text")).alias("text"))
    return joined.select(*columns)
