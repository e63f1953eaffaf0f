"""Token counts of a byte-pair vocabulary: ragged arrays of symbols, whose lowest-rank pairs merge round by round."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from solvelake.llm.hashing import U, mix

SPACE = "▁"
#: Characters that are held as arrays at a time.
GATHER = 1 << 20
#: Symbols beyond which a sequence, which is no natural word, would make its batch wait for thousands of rounds.
LONG = 1 << 10
NONE = np.int32(2**31 - 1)
#: Sequences of up to so many symbols are remembered, so many at a time.
SHORT, REMEMBERED = 32, 1 << 17


@dataclass(frozen=True)
class Vocabulary:
    """Symbols are the pieces and the characters in them. ``of_char`` names a character's symbol, or -1.

    ``cost`` is the number of tokens of a symbol that is left over: one for a piece, the bytes of a character that is
    none. ``keys`` (left * symbols + right, ascending) are the pairs that merge, with their ``ranks`` and what they
    ``form``. A rank is ``late`` if a piece it forms takes part in a pair of the same or a lower rank.
    """

    of_char: np.ndarray
    cost: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    form: np.ndarray
    late: np.ndarray
    beside: np.ndarray

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``NONE`` if it does not merge) and the symbol that it forms."""
        want = left.astype(np.int64) * len(self.cost) + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        found = self.keys[at] == want
        return np.where(found, self.ranks[at], NONE), self.form[at]

    def meet(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two characters (by symbol) stand side by side in any piece."""
        bit = left.astype(np.int64) * len(self.cost) + right
        return (self.beside[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def vocabulary(pieces: list[str], scores: list[float]) -> Vocabulary:
    """A vocabulary of ``pieces`` that merge by falling score, equal scores from left to right."""
    chars = sorted({c for p in pieces for c in p})
    names = {c: k for k, c in enumerate(chars)}  # characters first, so that the table of neighbours is small
    for p in pieces:
        names.setdefault(p, len(names))
    rank_of = {s: k for k, s in enumerate(sorted(set(scores), reverse=True))}
    rank = {p: rank_of[s] for p, s in zip(pieces, scores, strict=True)}
    known = set(pieces)
    cost = np.array([1 if s in known else len(s.encode()) for s in names], np.int64)
    n = len(names)
    pairs = sorted(
        (names[p[:k]] * n + names[p[k:]], rank[p], names[p])
        for p in pieces
        for k in range(1, len(p))
        if p[:k] in names and p[k:] in names
    )
    keys, ranks, form = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else [np.zeros(1, np.int64) - 1] * 3
    soonest = np.full(n, NONE, np.int64)
    np.minimum.at(soonest, keys // n, ranks)
    np.minimum.at(soonest, keys % n, ranks)
    late = np.zeros(len(rank_of) + 1, bool)
    late[ranks[soonest[form] <= ranks]] = True
    of_char = np.full(0x110000, -1, np.int32)
    of_char[[ord(c) for c in chars]] = np.arange(len(chars))
    bits = np.zeros((len(chars) * n + 8) // 8 + 1, np.uint8)
    for bit in {names[a] * n + names[b] for p in pieces for a, b in zip(p, p[1:], strict=False)}:
        bits[bit >> 3] |= 1 << (bit & 7)
    return Vocabulary(of_char, cost, keys, ranks.astype(np.int32), form.astype(np.int32), late, bits)


@functools.lru_cache(maxsize=2)
def sentencepiece_vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece BPE model with byte fallback, without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [
        i
        for i in range(model.get_piece_size())
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return vocabulary([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids])


def _in_turn(symbols: np.ndarray, v: Vocabulary) -> int:
    """Tokens of one sequence, one merge after the other: lowest rank first, then leftmost."""
    n = len(symbols)
    sym = symbols.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank, form = v.pairs(symbols[:-1], symbols[1:])
    some = rank != NONE
    queue = [r * n + i for r, i in zip(rank[some].tolist(), np.flatnonzero(some).tolist(), strict=True)]
    heapq.heapify(queue)
    seen = {
        (a, b): (r, f)
        for a, b, r, f in zip(symbols[:-1][some].tolist(), symbols[1:][some].tolist(), rank[some].tolist(), form[some].tolist(), strict=True)
    }

    def pair(a: int, b: int) -> tuple[int, int]:
        known = seen.get((a, b))
        if known is None:
            r, f = v.pairs(np.array([a]), np.array([b]))
            known = seen[a, b] = int(r[0]), int(f[0])
        return known

    while queue:
        r, i = divmod(heapq.heappop(queue), n)
        j = after[i]
        if sym[i] < 0 or j == n:
            continue
        now, formed = pair(sym[i], sym[j])
        if now != r:
            continue
        sym[i], sym[j] = formed, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            rank_k = pair(formed, sym[k])[0]
            if rank_k != NONE:
                heapq.heappush(queue, rank_k * n + i)
        if (h := before[i]) >= 0:
            rank_h = pair(sym[h], formed)[0]
            if rank_h != NONE:
                heapq.heappush(queue, rank_h * n + h)
    return int(v.cost[[s for s in sym if s >= 0]].sum())


def merged(symbols: np.ndarray, starts: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Tokens of each sequence; sequence k is ``symbols`` from ``starts[k]`` to the next start.

    A round takes the lowest rank of each sequence and merges all its pairs of that rank, from the left where they
    overlap. That equals one merge at a time, as long as what a merge forms has later ranks only; of a ``late`` rank
    only the first pair merges. Sequences of more than ``LONG`` symbols are left to an ordered queue.
    """
    out = np.zeros(len(starts), np.int64)
    own = np.arange(len(starts))
    sizes = np.diff(np.append(starts, len(symbols)))
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = _in_turn(symbols[starts[k] : starts[k] + sizes[k]], v)
    own, seq = own[sizes <= LONG], np.repeat(own, sizes)
    keep = (sizes <= LONG)[seq]
    symbols, seq = symbols[keep], seq[keep]
    rank, form = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int32)
    if len(symbols) > 1:
        rank[:-1], form[:-1] = v.pairs(symbols[:-1], symbols[1:])
        rank[:-1][seq[1:] != seq[:-1]] = NONE
    while len(symbols):
        starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        low = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(symbols)))
        ended = low == NONE
        if ended.any():
            counts = np.add.reduceat(v.cost[symbols], starts)
            out[seq[starts[ended]]] = counts[ended]
        go = np.repeat(~ended, sizes)
        hit = go & (rank == np.repeat(low, sizes))
        # Of overlapping pairs every other one merges, from the left.
        at = np.flatnonzero(hit)
        lead = np.append(True, at[1:] != at[:-1] + 1) if len(at) else np.zeros(0, bool)
        at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))) % 2 == 0]
        other = np.append(False, seq[at[1:]] == seq[at[:-1]])[: len(at)]
        at = at[~(other & v.late[rank[at]])]
        go[at + 1] = False
        symbols[at] = form[at]
        changed = np.zeros(len(symbols), bool)
        changed[at] = True
        symbols, seq, rank, form, changed = symbols[go], seq[go], rank[go], form[go], changed[go]
        look = np.flatnonzero(changed | np.append(changed[1:], False))
        whole = look[look + 1 < len(symbols)]
        rank[look] = NONE
        whole = whole[seq[whole] == seq[whole + 1]]
        rank[whole], form[whole] = v.pairs(symbols[whole], symbols[whole + 1])
    return out


def _distinct(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the first of equal sequences, and for each sequence which of these equals it."""
    sizes = np.diff(np.append(starts, len(symbols)))
    seq = np.repeat(np.arange(len(starts)), sizes)
    inside = np.arange(len(symbols)) - starts[seq]
    spread = mix(symbols.astype(U) * U(0x9E3779B97F4A7C15) + inside.astype(U))
    _, first, which = np.unique(np.add.reduceat(spread, starts), return_index=True, return_inverse=True)
    like = first[which]
    odd = sizes != sizes[like]  # equal hashes of unlike sequences: these stand for themselves
    twin = np.minimum(starts[like][seq] + inside, len(symbols) - 1)
    odd |= np.logical_or.reduceat(symbols != symbols[twin], starts)
    which[odd] = len(first) + np.arange(np.count_nonzero(odd))
    return np.append(first, np.flatnonzero(odd)), which


def _counted(symbols: np.ndarray, begin: np.ndarray, v: Vocabulary, known: dict[bytes, int]) -> np.ndarray:
    """Tokens of each sequence; only those that ``known`` has not yet are merged."""
    raw, ends = symbols.astype("<u4").tobytes(), np.append(begin[1:], len(symbols))
    names = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
    out = np.fromiter(map(known.get, names, [-1] * len(names)), np.int64, len(names))
    new = np.flatnonzero(out < 0)
    if len(new):
        sizes = (ends - begin)[new]
        starts = np.cumsum(sizes) - sizes
        picked = np.repeat(begin[new] - starts, sizes) + np.arange(sizes.sum())
        out[new] = merged(symbols[picked], starts, v)
        if len(known) > REMEMBERED:
            known.clear()
        known.update((names[k], int(out[k])) for k in new[sizes <= SHORT].tolist())
    return out


def count_codes(codes: np.ndarray, row: np.ndarray, rows: int, v: Vocabulary, known: dict[bytes, int]) -> np.ndarray:
    """Tokens of each row; ``row`` numbers the row of each character, ascending."""
    symbols = v.of_char[codes]
    strange = symbols < 0
    rare = codes[strange]
    size = 1 + (rare > 0x7F).astype(np.int64) + (rare > 0x7FF) + (rare > 0xFFFF)
    out = np.bincount(row[strange], size, rows).astype(np.int64)
    edge = np.ones(len(codes), bool)
    named = np.maximum(symbols, 0)
    edge[1:] = strange[1:] | strange[:-1] | (row[1:] != row[:-1]) | ~v.meet(named[:-1], named[1:])
    symbols, edge, row = symbols[~strange], edge[~strange], row[~strange]
    starts = np.flatnonzero(edge)
    if not len(starts):
        return out
    first, which = _distinct(symbols, starts)
    sizes = np.diff(np.append(starts, len(symbols)))[first]
    begin = np.cumsum(sizes) - sizes
    picked = np.repeat(starts[first] - begin, sizes) + np.arange(sizes.sum())
    tokens = _counted(symbols[picked], begin, v, known)
    return out + np.bincount(row[starts], tokens[which], rows).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.replace(" ", SPACE).encode("utf-32-le", "replace"), "<u4")


def _long_count(text: str, v: Vocabulary, known: dict[bytes, int]) -> int:
    """Tokens of a text that is read part by part, cut where no piece can stand across."""
    total, held = 0, _codes(SPACE)
    for at in range(0, len(text), GATHER):
        codes = np.concatenate([held, _codes(text[at : at + GATHER])])
        symbols = v.of_char[codes]
        named = np.maximum(symbols, 0)
        apart = (symbols[1:] < 0) | (symbols[:-1] < 0) | ~v.meet(named[:-1], named[1:])
        cuts = np.flatnonzero(apart)
        end = len(codes) if at + GATHER >= len(text) else int(cuts[-1]) + 1 if len(cuts) else 0
        if end:
            total += int(count_codes(codes[:end], np.zeros(end, np.int64), 1, v, known)[0])
        held = codes[end:]
    return total


def count_texts(texts: list[str], v: Vocabulary, known: dict[bytes, int]) -> list[int]:
    """Tokens of each text, as sentencepiece encodes it with a space in front. ``known`` is kept for further texts."""
    out = [0] * len(texts)
    held: list[tuple[int, np.ndarray]] = []
    n = 0

    def flush() -> None:
        nonlocal n
        if held:
            codes = np.concatenate([c for _, c in held])
            row = np.repeat(np.arange(len(held)), [len(c) for _, c in held])
            for (k, _), tokens in zip(held, count_codes(codes, row, len(held), v, known).tolist(), strict=True):
                out[k] = tokens
        held.clear()
        n = 0

    for k, text in enumerate(texts):
        if len(text) > GATHER:
            out[k] = _long_count(text, v, known)
        elif text:
            held.append((k, _codes(SPACE + text)))
            n += len(text)
            if n >= GATHER:
                flush()
    flush()
    return out


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Per row of ``docs``: ``n_bytes`` of its text, ``n_tokens`` under the sentencepiece BPE model file ``model``
    without begin and end, and whether these are more than ``limit``.

    The model is one with a space put in front, byte fallback and no other normalisation. A null or empty text has no
    bytes and no tokens. Repeated rows give repeated results; further columns are not read. Rows stay in their
    partition. A text of any length is read in parts of a million characters, cut where no piece can stand across.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = sentencepiece_vocabulary(model), {}
        for batch in batches:
            raw = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            texts = [x.as_buffer().to_pybytes().decode("utf-8", "replace") for x in raw]
            tokens = count_texts(texts, v, known)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x.as_buffer().size for x in raw], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
