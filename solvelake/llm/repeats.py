"""Which hashed places of a corpus occur again elsewhere: the exchange that the two substring operators share.

An occurrence is a place in a document with a 64-bit ``key`` and, perhaps, a longer ``ext``. Tasks gather their
occurrences, settle among themselves what they can, and send the rest as packed arrays to the part that the key picks.
A part answers each document with the places that are marked:

* ``LATER``: an occurrence of the same (key, ext) stands earlier.
* ``SHARED``: the key occurs elsewhere, but no earlier (key, ext) was found.

Documents are named by (doc_id, tk), tk being a hash of the text, so that rows of one id with other texts stay apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from solvelake.llm.base import discard, parts_for, row_key, store, told
from solvelake.llm.hashing import U, mix

SHARED, LATER = 0, 1
#: Occurrences that a task gathers before it packs them.
GATHER = 1 << 20

#: A packed occurrence: key, ext, document, and place << 2 | shared << 1 | has ext; column after column.
ROW = ("<u4", "<u4", "<u2", "<u4")
ROW_BYTES = 14

#: (row of the batch, position, key, ext, has ext) arrays; no ext at all as (None, None). Classes are told apart by the
#: part, the low half of the key, and the low half of ext.
Find = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]]


def named(docs: DataFrame) -> DataFrame:
    """``doc_id`` as a long, ``tk``, ``text``: rows with an id and a text. Ids are whole numbers."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError(f"doc_id is a whole number here, not {docs.schema['doc_id'].dataType.simpleString()}")
    return docs.filter("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text")).alias("tk"), "text"
    )


def _first(order: np.ndarray) -> np.ndarray:
    """True where an ascending array starts a new value."""
    out = np.ones(len(order), bool)
    out[1:] = order[1:] != order[:-1]
    return out


def settle(
    key: np.ndarray, ext: np.ndarray, has: np.ndarray, ids: np.ndarray, tks: np.ndarray, place: np.ndarray, within: bool
) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence, whether an earlier one has its (key, ext), and whether another one has its key.

    Earlier means a smaller doc_id or, ``within`` documents too, the same document and a smaller place. Without
    ``within``, others are those in documents of another doc_id.
    """
    later, shared = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if not len(key):
        return later, shared
    by_key = np.argsort(key, kind="stable")
    runs = np.flatnonzero(_first(key[by_key]))
    sizes = np.diff(np.append(runs, len(key)))
    some = np.repeat(sizes > 1, sizes)
    at = by_key[some]  # occurrences whose key is not alone
    if not len(at):
        return later, shared
    k, i = key[at], ids[at]
    if within:
        shared[at] = True
    else:
        starts = np.flatnonzero(_first(k))
        low, high = np.minimum.reduceat(i, starts), np.maximum.reduceat(i, starts)
        n = np.diff(np.append(starts, len(k)))
        shared[at] = np.repeat(low != high, n)
    at = at[has[at]]
    if not len(at):
        return later, shared
    order = at[np.lexsort((place[at], tks[at], ids[at], ext[at], key[at]))]
    new = _first(key[order]) | _first(ext[order])
    starts = np.flatnonzero(new)
    n = np.diff(np.append(starts, len(order)))
    if within:
        lead = np.repeat(order[starts], n)
        later[order] = (ids[order] != ids[lead]) | (tks[order] != tks[lead]) | (place[order] != place[lead])
    else:
        later[order] = ids[order] > np.repeat(ids[order[starts]], n)
    return later, shared


ANSWERS = "bucket int, docs binary, tks binary, counts binary, marks binary"


def answer_batch(ids: np.ndarray, tks: np.ndarray, doc: np.ndarray, marks: np.ndarray, parts: int) -> pa.RecordBatch:
    """Marks (64 bits each) of documents, packed in one row for each bucket of documents; ``doc`` indexes them."""
    bucket = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)[doc]
    order = np.lexsort((doc, bucket))
    edges = np.flatnonzero(_first(bucket[order])) if len(order) else np.zeros(0, np.int64)
    out: list[list] = [[], [], [], [], []]
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=False):
        rows = order[a:b]
        starts = np.flatnonzero(_first(doc[rows]))
        own = doc[rows[starts]]
        values = (
            int(bucket[rows[0]]), ids[own].tobytes(), tks[own].tobytes(),
            np.diff(np.append(starts, len(rows))).astype("<u4").tobytes(), marks[rows].astype("<u8").tobytes(),
        )
        for column, value in zip(out, values, strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays(
        [pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]],
        names=["bucket", "docs", "tks", "counts", "marks"],
    )


def per_document(answers: DataFrame) -> DataFrame:
    """``doc_id``, ``tk`` and all ``marks`` of each document, from packed answers."""
    parts = parts_for(answers.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tks, counts, marks = [], [], [], []
        for batch in batches:
            lists = (("docs", ids, "<i8"), ("tks", tks, "<i8"), ("counts", counts, "<u4"), ("marks", marks, "<u8"))
            for column, into, kind in lists:
                into += [np.frombuffer(x, kind) for x in batch.column(column).to_pylist()]
        if not ids:
            return
        ids, tks, counts, marks = (np.concatenate(x) for x in (ids, tks, counts, marks))
        first = np.cumsum(counts, dtype=np.int64) - counts
        order = np.lexsort((tks, ids))
        starts = np.flatnonzero(_first(ids[order]) | _first(tks[order]))
        rows: list[tuple[int, int, bytes]] = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            own = order[a:b]
            together = b"".join(marks[first[k] : first[k] + counts[k]].tobytes() for k in own)
            rows.append((int(ids[own[0]]), int(tks[own[0]]), together))
            if len(rows) >= 2048:
                yield _document_batch(rows)
                rows = []
        if rows:
            yield _document_batch(rows)

    return answers.repartitionById(parts, "bucket").mapInArrow(gather, "_d long, _t long, _m binary")


def _document_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    ids, tks, marks = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(tks, pa.int64()), pa.array(marks, pa.binary())], names=["_d", "_t", "_m"]
    )


def _pack(gathered: list, parts: int, within: bool) -> pa.RecordBatch:
    ids, tks = (np.concatenate([g[k] for g in gathered]) for k in (0, 1))
    base = np.cumsum([0, *[len(g[0]) for g in gathered[:-1]]])
    doc = np.concatenate([g[2] + b for g, b in zip(gathered, base, strict=True)])
    place, key, ext, has = (np.concatenate([g[k] for g in gathered]) for k in (3, 4, 5, 6))
    later, shared = settle(key, ext, has, ids[doc], tks[doc], place, within)
    # Settled here: occurrences with an earlier one in this task. Their part need not see them; it hands the answer on.
    done = later.copy()
    if within:
        # So are copies of a key without ext, which are shared whatever stands elsewhere; one of them goes on.
        copies = np.flatnonzero(shared & ~has)
        done[copies] = True
        done[copies[np.unique(key[copies], return_index=True)[1]]] = False
    settled = answer_batch(ids, tks, doc[done], place[done].astype(np.uint64) << U(1) | later[done], parts)
    rows = [r | {"part": r["bucket"]} for r in settled.to_pylist()]
    # A key that one task finds shared stays so: the mark travels with the occurrence.
    go = np.flatnonzero(~done)
    to = ((key[go] >> U(32)) % U(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    go, to = go[order], to[order]
    edges = np.searchsorted(to, np.arange(parts + 1))
    for part in np.unique(to).tolist():
        at = go[edges[part] : edges[part + 1]]
        own, index = np.unique(doc[at], return_inverse=True)
        packed = (
            key[at].astype("<u4"), ext[at].astype("<u4"), index.astype("<u2"),
            (place[at] << 2 | shared[at] << 1 | has[at]).astype("<u4"),
        )
        rows.append(
            {"part": part, "docs": ids[own].tobytes(), "tks": tks[own].tobytes(), "rows": b"".join(c.tobytes() for c in packed)}
        )
    return pa.RecordBatch.from_pylist(rows, SENT)


SENT = pa.schema(
    [("part", pa.int32()), ("docs", pa.binary()), ("tks", pa.binary()), ("rows", pa.binary()),
     ("bucket", pa.int32()), ("counts", pa.binary()), ("marks", pa.binary())]
)


def marked(table: DataFrame, find: Find, within: bool) -> DataFrame:
    """Packed answers (see ``per_document``): the marked places of documents, place << 1 | mark.

    ``table`` has doc_id, tk and what ``find`` reads. Positions stay below 2**30.
    """
    parts = parts_for(table.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, docs = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, tks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tk"))
            for row, place, key, ext, has in find(batch):
                if not len(row):
                    continue
                own, index = np.unique(row, return_inverse=True)
                ext, has = (key, np.zeros(len(key), bool)) if ext is None else (ext, has)
                held.append((ids[own], tks[own], index, place.astype(np.uint32), key, ext, has))
                n, docs = n + len(row), docs + len(own)
                if n >= GATHER or docs > 30_000:
                    yield _pack(held, parts, within)
                    held, n, docs = [], 0, 0
        if held:
            yield _pack(held, parts, within)

    sent = table.mapInArrow(
        gather, "part int, docs binary, tks binary, rows binary, bucket int, counts binary, marks binary"
    ).repartitionById(parts, "part")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tks, rows, base = [], [], [], 0
        for batch in batches:
            done = batch.filter(batch.column("bucket").is_valid())
            if done.num_rows:
                yield done.select(["bucket", "docs", "tks", "counts", "marks"])
            for r in batch.filter(batch.column("bucket").is_null()).to_pylist():
                ids.append(np.frombuffer(r["docs"], "<i8"))
                tks.append(np.frombuffer(r["tks"], "<i8"))
                n, at, columns = len(r["rows"]) // ROW_BYTES, 0, []
                for kind in ROW:
                    columns.append(np.frombuffer(r["rows"], kind, n, at))
                    at += columns[-1].nbytes
                columns[2] = columns[2].astype(np.int32) + base
                rows.append(columns)
                base += len(ids[-1])
        if rows:
            all_ids, all_tks = np.concatenate(ids), np.concatenate(tks)
            key, ext, doc, packed = (np.concatenate([x[k] for x in rows]) for k in range(4))
            place = packed >> 2
            later, shared = settle(key, ext, packed & 1 == 1, all_ids[doc], all_tks[doc], place, within)
            found = np.flatnonzero(later | shared | (packed >> 1 & 1 == 1))
            yield answer_batch(all_ids, all_tks, doc[found], place[found].astype(np.uint64) << U(1) | later[found], parts)

    return sent.mapInArrow(answer, ANSWERS)


def with_answers(table: DataFrame, answers: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The documents of ``table`` that have answers, with all answers of a document as one binary ``name``; stored, with
    the path.

    The answers of one document are bounded by its length. Texts without answers are not shuffled if the others are
    few enough (see ``told``).
    """
    per_doc, path = store(per_document(answers), "answers")
    same = [F.col("doc_id") == F.col("_d"), F.col("tk") == F.col("_t")]
    wanted = table.join(told(per_doc.select("_d", "_t")), same, "left_semi")
    out = store(wanted.join(per_doc, same).withColumnRenamed("_m", name).drop("_d", "_t"), name)
    discard(table.sparkSession, path)
    return out


def beside_answers(table: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """All of ``table``, with the answers of a document as ``name``, null where there are none."""
    per_doc, _ = store(per_document(answers), "answers")
    same = [F.col("doc_id") == F.col("_d"), F.col("tk") == F.col("_t")]
    return table.join(per_doc, same, "left").withColumnRenamed("_m", name).drop("_d", "_t")


def unpack(marks: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and whether they are ``LATER``."""
    raw = np.frombuffer(marks or b"", "<u8")
    return (raw >> U(1)).astype(np.int64), raw & U(1) == LATER


def runs_of(flags: np.ndarray, width: int) -> np.ndarray:
    """Positions covered by ``width`` long windows that start where ``flags`` is set; as long as ``flags`` + width - 1."""
    steps = np.zeros(len(flags) + width, np.int32)
    np.add.at(steps, np.flatnonzero(flags), 1)
    np.subtract.at(steps, np.flatnonzero(flags) + width, 1)
    return np.cumsum(steps)[:-1] > 0
