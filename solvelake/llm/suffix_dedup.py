"""Repeated byte strings, found by a distributed merge sort of suffixes that carries common prefixes along.

Suffixes are sorted only where a repeat can be: at content-defined places (``anchors``) whose next bytes occur
elsewhere. Tasks sort their suffixes, front-code the runs and exchange them; each part merges its runs with a loser
tree that compares prefix lengths first and bytes only beyond what is known to be equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvelake.llm.base import discard, free_shuffles, parts_for, row_key
from solvelake.llm.hashing import _INV, _POW, BYTES, CHUNK, U, mix, text_pieces
from solvelake.llm.repeats import ANSWERS, _first, answer_batch, beside_answers, marked, named, runs_of, unpack, with_answers

PIECE = 1 << 18
#: Bytes that are hashed at once.
STRETCH = CHUNK - 1024
TOP = np.uint64(2**64 - 1)
#: Suffixes that a task sorts into one run.
RUN = 1 << 17


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTES[data] * _POW[: len(data)], out=sums[1:])
    return sums


def window_hashes(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the strings of ``size`` bytes at ascending places; a long text goes part by part."""
    out = np.empty(len(at), U)
    first = 0
    while first < len(at):
        base = int(at[first])
        last = int(np.searchsorted(at, base + STRETCH, "left"))
        own = at[first:last] - base
        sums = _sums(data[base : base + STRETCH + size])
        out[first:last] = mix((sums[own + size] - sums[own]) * _INV[own])
        first = last
    return out


def _sliding(values: np.ndarray, width: int, combine) -> np.ndarray:
    """``combine`` of every ``width`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = combine(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return combine(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, ascending, and hashes of the ``length`` // 2 bytes there.

    A place is an anchor if its hash is the least in some ``length`` long string around it. So any two equal strings
    of that length hold an anchor at the same offset, at most half of ``length``.
    """
    short = length // 2
    width = length - short + 1
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, U))]
    # A long text goes part by part, with as much on either side as an anchor depends on.
    for begin in range(0, len(data), STRETCH):
        low, high = max(0, begin - length), min(len(data), begin + STRETCH + length)
        if high - low < length:
            continue
        sums = _sums(data[low:high])
        hashes = mix((sums[short:] - sums[:-short]) * _INV[: high - low - short + 1])
        places = np.arange(low, low + len(hashes))
        room = offsets[np.searchsorted(offsets, places, "right")] - places  # bytes left in the document
        hashes[room < short] = TOP
        least = _sliding(hashes, width, np.minimum)
        least[room[: len(least)] < length] = 0
        padded = np.concatenate([np.zeros(width - 1, U), least, np.zeros(width - 1, U)])
        at = np.flatnonzero((hashes == _sliding(padded, width, np.maximum)) & (hashes != TOP))
        at = at[(at + low >= begin) & (at + low < begin + STRETCH)]
        found.append((at + low, hashes[at]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _find_anchors(length: int):
    def find(batch: pa.RecordBatch):
        for row, offsets, data in text_pieces(batch.column("text"), PIECE):
            at, key = anchors(data, offsets, length)
            if len(at):
                doc = np.searchsorted(offsets, at, "right") - 1
                yield doc + row, at - offsets[doc], key, None, None

    return find


# Front-coded runs


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree in the first ``known`` bytes."""
    top = min(len(a), len(b))
    if a[known:top] == b[known:top]:
        return top
    low = known  # agree before low, differ before top
    while top - low > 1:
        mid = (low + top) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            top = mid
    return low


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """For ascending strings: bytes shared with the one before, bytes of their own, and those bytes."""
    shared, tails, last = [], [], b""
    for s in strings:
        n = common(last, s)
        shared.append(n)
        tails.append(s[n:])
        last = s
    return np.array(shared, np.uint16), np.array([len(t) for t in tails], np.uint16), b"".join(tails)


def front_decode(shared: np.ndarray, own: np.ndarray, tails: bytes) -> Iterator[tuple[bytes, int]]:
    """The strings again, each with the bytes shared with the one before."""
    last, at = b"", 0
    for n, k in zip(shared.tolist(), own.tolist(), strict=True):
        last = last[:n] + tails[at : at + k]
        at += k
        yield last, n


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, length, bytes shared with the string before) of all strings of ascending runs, in order.

    A loser tree. Each waiting string knows how many bytes it shares with the last one given out. Of two strings the
    one that shares more is less; only equal ones are compared, from there on, and the loser keeps what it shares
    with the winner. No byte that is known to be equal is looked at again.
    """
    size = 1
    while size < len(runs):
        size *= 2
    ended = (None, 0)
    heads = [next(r, ended) for r in runs] + [ended] * (size - len(runs))
    strings: list[bytes | None] = [h[0] for h in heads]
    shared = [0] * size
    losers = [0] * size

    def lower(a: int, b: int) -> int:
        """The run with the lesser head; the other's shared length is brought up to date."""
        x, y = strings[a], strings[b]
        if x is None or y is None:
            return b if x is None else a
        if shared[a] != shared[b]:
            return a if shared[a] > shared[b] else b
        n = common(x, y, shared[a])
        if x[n : n + 1] <= y[n : n + 1]:
            shared[b] = n
            return a
        shared[a] = n
        return b

    tree = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = lower(a, b)
        losers[node] = b if tree[node] == a else a
    top = tree[1]
    while strings[top] is not None:
        yield top, len(strings[top]), shared[top]
        strings[top], shared[top] = next(runs[top], ended)
        node = (size + top) >> 1
        best = top
        while node:
            other = losers[node]
            if strings[other] is not None:
                if strings[best] is None:
                    losers[node], best = best, other
                elif shared[other] > shared[best]:
                    losers[node], best = best, other
                elif shared[other] == shared[best] and lower(best, other) == other:
                    losers[node], best = best, other
            node >>= 1
        top = best


def _runs(short: int, cap: int, parts: int):
    """Sorted, front-coded runs of the suffixes at marked anchors, for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int]] = []  # suffix, document, place
        names: list[tuple[int, int]] = []
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            ids, tks = batch.column("doc_id").to_pylist(), batch.column("tk").to_pylist()
            for text, doc, tk, marks in zip(texts, ids, tks, batch.column("marks").to_pylist(), strict=True):
                for p in np.unique(unpack(marks)[0]).tolist():
                    held.append((text[p : p + cap], len(names), p))
                names.append((doc, tk))
                if len(held) >= RUN or len(names) > 30_000:
                    yield _sorted_runs(held, names, short, cap, parts)
                    held, names = [], []
        if held:
            yield _sorted_runs(held, names, short, cap, parts)

    return run


RUNS = (
    "part int, docs binary, tks binary, shared binary, own binary, tails binary, copied binary, doc binary, "
    "place binary, bucket int, counts binary, marks binary"
)
SENT = pa.schema(
    [(c.split()[0], pa.int32() if c.endswith("int") else pa.binary()) for c in RUNS.split(", ")]
)


def _sorted_runs(held: list, names: list, short: int, cap: int, parts: int) -> pa.RecordBatch:
    """Of equal suffixes the earliest goes to its part, with a mark that it has copies; the others are answered here."""
    ordered = sorted(set(names))
    ids, tks = np.array([n[0] for n in ordered], np.int64), np.array([n[1] for n in ordered], np.int64)
    rank = {n: i for i, n in enumerate(ordered)}
    # The part depends on the bytes that equal anchors share, so that all suffixes with a common anchor meet.
    by_part: dict[int, list] = {}
    for s, doc, p in held:
        part = int.from_bytes(hashlib.blake2b(s[:short], digest_size=4).digest()) % parts
        by_part.setdefault(part, []).append((s, rank[names[doc]], p))
    rows, settled = [], []
    for part, entries in by_part.items():
        entries.sort()
        strings, firsts, copied = [], [], []
        for s, doc, p in entries:
            if strings and strings[-1] == s:
                copied[-1] = 1
                if (doc, p) != firsts[-1]:  # a repeated row of one document is no later copy
                    settled.append((doc, p, cap + 1 if len(s) == cap else len(s)))
            else:
                strings.append(s)
                firsts.append((doc, p))
                copied.append(0)
        shared, own, tails = front_code(strings)
        used, index = np.unique([f[0] for f in firsts], return_inverse=True)
        rows.append({
            "part": part, "docs": ids[used].tobytes(), "tks": tks[used].tobytes(), "shared": shared.tobytes(),
            "own": own.tobytes(), "tails": tails, "copied": np.array(copied, np.uint8).tobytes(),
            "doc": index.astype(np.uint16).tobytes(), "place": np.array([f[1] for f in firsts], np.uint32).tobytes(),
        })
    if settled:
        doc, place, value = np.array(settled, np.int64).T
        found = value >= short
        answers = answer_batch(ids, tks, doc[found], place[found] << 8 | value[found], parts)
        rows += [r | {"part": r["bucket"]} for r in answers.to_pylist()]
    return pa.RecordBatch.from_pylist(rows, SENT)


def _merged(short: int, cap: int, parts: int):
    """Merge a part's runs; answer each document with (place << 8 | bytes shared) of its suffixes.

    A suffix shares ``cap`` + 1 if all its ``cap`` bytes also start earlier, else as many bytes as it has in common
    with any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, copied, docs, doc, place, base = [], [], [], [], [], 0
        for batch in batches:
            done = batch.filter(batch.column("bucket").is_valid())
            if done.num_rows:
                yield done.select(["bucket", "docs", "tks", "counts", "marks"])
            for r in batch.filter(batch.column("bucket").is_null()).to_pylist():
                runs.append(
                    front_decode(np.frombuffer(r["shared"], "<u2"), np.frombuffer(r["own"], "<u2"), r["tails"])
                )
                copied.append(np.frombuffer(r["copied"], np.uint8) == 1)
                docs.append((np.frombuffer(r["docs"], np.int64), np.frombuffer(r["tks"], np.int64)))
                doc.append(np.frombuffer(r["doc"], "<u2").astype(np.int64) + base)
                place.append(np.frombuffer(r["place"], "<u4").astype(np.int64))
                base += len(docs[-1][0])
        if not runs:
            return
        order = np.fromiter(
            (x for item in merge(runs) for x in item), np.int64, 3 * sum(len(c) for c in copied)
        ).reshape(-1, 3)
        source, length, shared = order.T
        # The place of each merged string among all strings of all runs, run after run.
        first_string = np.cumsum([0, *[len(c) for c in copied]])
        by_run = np.argsort(source, kind="stable")
        string = np.empty(len(source), np.int64)
        string[by_run] = np.arange(first_string[-1])
        doc, place, has_copies = (np.concatenate(x)[string] for x in (doc, place, copied))
        # Equal strings, each the earliest of its run, are a class.
        new = np.ones(len(source), bool)
        new[1:] = (shared[1:] != length[1:]) | (length[1:] != length[:-1])
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(source)))
        before, whole = shared[starts].copy(), length[starts]
        before[0] = 0
        most = np.maximum(before, np.append(before[1:], 0))
        most = np.where((size > 1) | np.logical_or.reduceat(has_copies, starts), whole, most)
        group = np.repeat(np.arange(len(starts)), size)
        ids, tks = (np.concatenate([d[k] for d in docs]) for k in (0, 1))
        ranked = np.lexsort((place, tks[doc], ids[doc], group))
        lead = np.repeat(ranked[np.flatnonzero(_first(group[ranked]))], size)
        same = (ids[doc[ranked]] == ids[doc[lead]]) & (tks[doc[ranked]] == tks[doc[lead]]) & (place[ranked] == place[lead])
        later = np.zeros(len(group), bool)
        later[ranked] = ~same
        value = np.where(later & (whole[group] == cap), cap + 1, most[group])
        found = np.flatnonzero(value >= short)
        marks = place[found] << 8 | value[found]
        yield answer_batch(ids, tks, doc[found], marks, parts)

    return run


def _settled(n: int, length: int, cap: int, sorted_marks: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Strings of ``length`` (by start) known to start earlier too, and those that may."""
    raw = np.frombuffer(sorted_marks or b"", "<u8")
    place, value = (raw >> 8).astype(np.int64), (raw & 255).astype(np.int64)
    count = max(0, n - length + 1)
    half = length - length // 2
    steps = np.zeros((2, count + 1), np.int32)
    full = value > cap
    low = [place[full], np.maximum(place - half, 0)]
    high = [place[full] + cap - length, np.minimum(place, place + value - length)]
    for k in (0, 1):
        ok = high[k] >= low[k]
        np.add.at(steps[k], np.minimum(low[k][ok], count), 1)
        np.subtract.at(steps[k], np.minimum(high[k][ok] + 1, count), 1)
    known = np.cumsum(steps[0])[:count] > 0
    return known, (np.cumsum(steps[1])[:count] > 0) & ~known


def repeated_strings(docs: DataFrame, length: int = 100) -> DataFrame:
    """``doc_id``, ``tk``, ``text``, ``sorted``, ``more`` of documents that may repeat a string of ``length`` bytes.

    The suffixes at anchors whose first ``length`` / 2 bytes occur again are sorted by their first 3 / 2 ``length``
    (+ 1) bytes. A suffix that stands earlier with all of those settles every string that starts up to the next
    anchor. What a suffix shares with its neighbours in the order bounds which strings around it may be repeated;
    those, at the ends of repeated passages and in their first copies, are compared one by one. The first copy of a
    string is never settled, so none is missed.
    """
    if not 4 <= length <= 160:
        raise ValueError("length is 4 to 160 bytes")
    cap = length + length - length // 2 + 1
    parts = parts_for(docs.sparkSession)
    table = named(docs)
    held, path = with_answers(table, marked(table, _find_anchors(length), True), "marks")
    free_shuffles(docs.sparkSession)
    runs = held.mapInArrow(_runs(length // 2, cap, parts), RUNS).repartitionById(parts, "part")
    merged = runs.mapInArrow(_merged(length // 2, cap, parts), ANSWERS)
    placed, _ = with_answers(held.drop("marks"), merged, "sorted")
    discard(docs.sparkSession, path)
    free_shuffles(docs.sparkSession)

    def find(batch: pa.RecordBatch):
        marks = batch.column("sorted").to_pylist()
        for row, offsets, data in text_pieces(batch.column("text"), PIECE):
            starts = []
            for d in range(len(offsets) - 1):
                _, maybe = _settled(int(offsets[d + 1] - offsets[d]), length, cap, marks[row + d])
                starts.append(np.flatnonzero(maybe) + offsets[d])
            at = np.concatenate(starts)
            if len(at):
                key = window_hashes(data, at, length)
                doc = np.searchsorted(offsets, at, "right") - 1
                yield doc + row, at - offsets[doc], key, key >> U(32), np.ones(len(at), bool)

    return beside_answers(placed, marked(placed, find, True), "more")


def suffix_dedup(docs: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` and, if asked for, the remaining bytes as ``kept``.

    A byte goes if a string of ``length`` bytes of its document covers it that also starts earlier: in a document
    with a smaller doc_id, or before in the same one, overlapping or not, whatever goes there. Null and empty texts
    have no bytes. Equal rows of one doc_id count as one document; rows of one id with different texts stand in the
    order of a hash of their text. Rows without a doc_id stay whole and are no source. A doc_id that
    is no whole number is refused with a TypeError.
    """
    cap = length + length - length // 2 + 1
    found = repeated_strings(docs, length)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            columns = (batch.column(c).to_pylist() for c in ("sorted", "more"))
            for text, marks, more in zip(texts, *columns, strict=True):
                again, _ = _settled(len(text), length, cap, marks)
                place, later = unpack(more)
                again[place[later]] = True
                if again.any():
                    gone = runs_of(again, length)
                    left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                else:
                    left, spans = text, 0
                rows.append((len(text) - len(left), spans, left))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("tk"), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
                    pa.array([r[2] if with_text else None for r in rows], pa.binary()),
                ],
                names=["_d", "_t", "_n", "_spans", "_sha", "_kept"],
            )

    removed = found.mapInArrow(remove, "_d long, _t long, _n long, _spans long, _sha string, _kept binary")
    removed = removed.filter("_n > 0").dropDuplicates(["_d", "_t"])
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select(
        "doc_id", row_key(F.col("text")).alias("tk"), F.octet_length(raw).cast("long").alias("n_bytes"),
        F.sha2(raw, 256).alias("sha"), (raw if with_text else F.lit(None).cast("binary")).alias("raw"),
    )
    joined = base.join(removed, (F.col("doc_id") == F.col("_d")) & (F.col("tk") == F.col("_t")), "left")
    columns = [
        "doc_id", "n_bytes", F.coalesce("_n", F.lit(0)).alias("n_removed"),
        F.coalesce("_spans", F.lit(0)).alias("n_spans"), F.coalesce("_sha", "sha").alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(F.col("_n").isNull(), F.col("raw")).otherwise(F.col("_kept")).alias("kept"))
    return joined.select(*columns)
