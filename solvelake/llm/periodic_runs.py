"""Periodic runs of words: a suffix automaton whose suffix links are kept as a link-cut tree, one access a word."""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from solvelake.llm.hashing import U, mix

#: Runs are this long at least, and two periods.
LEAST = 12
#: Words that are searched for repeats at a time; a longer document is taken alone.
GATHER = 1 << 19

COLUMNS = (
    "doc_id {id}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string"
)


def squares(words: Iterable[int], size: int) -> Iterator[tuple[int, int, int]]:
    """(end, period, length) of every repetition of two periods or more that cannot be extended to the left.

    ``words`` are ``size`` numbers. After each word, the access to its state in the link-cut tree of suffix links walks
    the paths from the state to the root. All states of a path were last seen at one place, its colour; the deepest
    gives the longest suffix that ended there. If that suffix is no shorter than the distance, the two occurrences
    overlap or touch and form a repetition whose smallest period is the distance. The walk joins the paths to one, with
    the present place as its colour; an access costs logarithmic time, amortised.
    """
    blank = array("i", bytes(4 * (2 * size + 2)))
    depth, link, word, to = blank[:], blank[:], blank[:], blank[:]
    left, right, above, colour = blank[:], blank[:], blank[:], blank[:]
    more: dict[int, dict[int, int]] = {}  # transitions of a state but its first

    def splay(x: int) -> None:
        while True:
            y = above[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = above[y]
            inner = z and (left[z] == y or right[z] == y)
            turns = ((y if (left[z] == y) == (left[y] == x) else x), x) if inner else (x,)
            for c in turns:
                b = above[c]
                a = above[b]
                if a and left[a] == b:
                    left[a] = c
                elif a and right[a] == b:
                    right[a] = c
                else:
                    colour[c] = colour[b]
                if left[b] == c:
                    t = left[b] = right[c]
                    right[c] = b
                else:
                    t = right[b] = left[c]
                    left[c] = b
                if t:
                    above[t] = b
                above[b] = c
                above[c] = a

    last, states = 1, 1
    for end, w in enumerate(words):
        new = states = states + 1
        depth[new] = depth[last] + 1
        p, q = last, 0
        while p:
            if not to[p]:
                word[p], to[p] = w, new
            elif word[p] == w:
                q = to[p]
                break
            else:
                others = more.setdefault(p, {})
                q = others.get(w, 0)
                if q:
                    break
                others[w] = new
            p = link[p]
        if not p:
            parent = 1
        elif depth[p] + 1 == depth[q]:
            parent = q
        else:
            parent = states = states + 1
            depth[parent], link[parent], word[parent], to[parent] = depth[p] + 1, link[q], word[q], to[q]
            if q in more:
                more[parent] = more[q].copy()
            splay(q)  # the copy takes its place right above q, on the same path
            upper = left[q]
            left[parent], right[parent], above[parent], colour[parent] = upper, q, above[q], colour[q]
            if upper:
                above[upper] = parent
            left[q], above[q], link[q] = 0, parent, parent
            while p:
                if word[p] == w and to[p] == q:
                    to[p] = parent
                elif p in more and more[p].get(w) == q:
                    more[p][w] = parent
                else:
                    break
                p = link[p]
        link[new] = above[new] = parent
        joined, x = new, parent
        while x:
            splay(x)
            seen = colour[x]
            if seen < end and end - seen <= depth[x]:
                yield end, end - seen, depth[x] + end - seen
            if right[x]:
                colour[right[x]] = seen
            right[x] = joined
            joined, x = x, above[x]
        colour[joined] = end
        last = new


def _gram_keys(hashes: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(hashes), U)
    n = len(hashes) - size + 1
    if n > 0:
        out[:n] = hashes[:n]
        for k in range(1, size):
            out[:n] = mix(out[:n] * U(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out


def islands(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of words such that every run lies inside one of them.

    ``hashes`` are those of all words, ``doc`` the ascending number of each word's document. A run of period 6 * 2^j to
    12 * 2^j (or less, for j = 0) repeats each of its stretches of 6 * 2^j words nearer than two such lengths, and they
    cover it. Equal hashes of different words only add stretches.
    """
    total, size = len(hashes), LEAST // 2
    steps = np.zeros(total + 1, np.int32)
    key = _gram_keys(hashes, size)
    at = np.arange(max(0, total - size + 1))
    at = at[doc[at] == doc[at + size - 1]]
    while len(at):
        named = mix(key[at] ^ mix(doc[at].astype(U)))
        order = np.argsort(named, kind="stable")
        place = at[order]
        same = np.flatnonzero((named[order][1:] == named[order][:-1]) & (doc[place[1:]] == doc[place[:-1]]))
        near = same[place[same + 1] - place[same] < 2 * size]
        marked = np.unique(np.concatenate([place[near], place[near + 1]]))
        steps[marked] += 1
        steps[marked + size] -= 1
        twice = np.zeros(total + size, bool)
        twice[place[same]] = twice[place[same + 1]] = True
        at = np.flatnonzero(twice[:total] & twice[size:])
        at = at[doc[at] == doc[at + size]]
        following = key[at] * U(0xD6E8FEB86659FD93) + mix(key[at + size])
        key[at] = mix(following)
        size *= 2
    inside = np.cumsum(steps[:-1]) > 0
    edge = np.ones(total, bool)
    edge[1:] = (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], total)
    return starts[inside[starts]], ends[inside[starts]]


def runs_within(words: list[bytes], first: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``words`` that lie in [first, end)."""
    names: dict[bytes, int] = {}
    numbers = [names.setdefault(w, len(names)) for w in words[first:end]]
    for last, period, length in squares(numbers, len(numbers)):
        if length >= LEAST:
            after = first + last + 1
            if after == len(words) or words[after] != words[after - period]:
                yield after - length, length, period


def runs_of_documents(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each list of words, by start, then period.

    A run is a stretch of words with smallest period q, of max(12, 2q) words or more, that no neighbour extends.
    """
    sizes = np.array([len(w) for w in documents], np.int64)
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(documents)), sizes)
    hashes = np.fromiter((hash(w) for words in documents for w in words), np.int64, int(sizes.sum())).view(U)
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    for a, b in zip(*(x.tolist() for x in islands(mix(hashes), doc)), strict=True):
        d, base = int(doc[a]), int(begin[doc[a]])
        found[d] += runs_within(documents[d], a - base, b - base)
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def repeated_tail(words: list[bytes], doc_id: object) -> list[bytes]:
    """The words, or for a tenth of the ids, chosen by checksum, words whose tail repeats its beginning."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stand in no run after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def _row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = b" ".join(collapsed(words, runs))
    return len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Per row of ``docs``: the number of runs, the longest run (ties: smallest start, then period) with its exponent
    in thousandths, and digests of all runs and of the text without the repeats.

    ``plant`` first gives a tenth of the documents a repeating tail (``repeated_tail``), by their ids; a null id plants
    none. Words are stretches without white space, taken as bytes. A null or empty text has no words and no run: four
    nulls and the digests of empty strings. Repeated rows give repeated results; further columns are not read. Rows
    stay in their partition, and the memory of a task follows from its longest document.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, held, n = batch.column("doc_id").to_pylist(), [], [], 0
            for doc_id, text in zip(ids, batch.column("text"), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                held.append(repeated_tail(words, doc_id) if plant else words)
                n += len(words)
                if n >= GATHER:
                    rows += map(_row, held, runs_of_documents(held))
                    held, n = [], 0
            rows += map(_row, held, runs_of_documents(held))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=[x.split()[0] for x in COLUMNS.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(search, COLUMNS.format(id=dict(docs.dtypes)["doc_id"]))
