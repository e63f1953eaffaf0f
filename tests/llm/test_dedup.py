"""The three deduplication operators against plain versions, and their edge cases."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from llm import brute, odd
from llm.conftest import SMALL, documents

from solvelake.llm import components, hashing, minhash_dedup, repeats, substring_dedup, suffix_dedup
from solvelake.llm.queries import QUERIES


def by_id(df, *cols):
    out = {}
    for r in df.filter("doc_id is not null").select("doc_id", *cols).collect():
        value = tuple(r[1:])
        assert out.setdefault(r[0], value) == value, r
    return out


# Near duplicates


def test_near_duplicates_query(spark):
    df = QUERIES["op1_minhash_dedup"](spark, SMALL)
    want = brute.near_duplicates(documents(), 85)
    got = by_id(df, "n_shingles", "component_id", "kept")
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}
    assert dict(df.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


def test_chains_groups_and_percent(spark):
    """Chains of edits, where the ends of a component are far apart, and groups of near copies larger than a block."""
    rng = random.Random(3)
    docs, n = [], 0
    for _ in range(6):
        words = [f"w{rng.random()}" for _ in range(150)]
        for _ in range(12):
            words = edited(rng, words, 2)
            docs.append((n := n + 1, " ".join(words)))
    words = [f"g{rng.random()}" for _ in range(200)]
    for _ in range(80):
        docs.append((n := n + 1, " ".join(edited(rng, words, rng.choice([1, 2, 5, 9])))))
    docs += [(n := n + 1, docs[0][1]) for _ in range(30)]
    rng.shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for percent in (80, 85):
        index = minhash_dedup.index_for(percent)
        index = minhash_dedup.Index(index.chunks, index.width, index.max_distance, block=16)
        got = by_id(minhash_dedup.near_duplicates(table, percent, index=index), "n_shingles", "component_id")
        assert got == brute.near_duplicates(docs, percent)


def test_near_duplicates_odd(spark):
    out = minhash_dedup.near_duplicates(odd.docs(spark), 80)
    assert sorted(tuple(r)[1:] for r in out.filter("doc_id is null").collect()) == [(0, None, True), (56, None, True)]
    got = by_id(out, "n_shingles", "component_id", "kept")
    want = brute.near_duplicates(odd.pairs(), 80)
    assert out.count() == len(odd.rows()) and {d: v[:2] for d, v in got.items()} == want
    assert want[4][1] == want[5][1] == want[6][1] == -3 and want[11][1] == 10
    assert got[2] == (0, 2, True)
    assert minhash_dedup.near_duplicates(odd.empty(spark), 80).count() == 0
    kept = minhash_dedup.keep_one(odd.docs(spark))
    assert kept.columns == odd.docs(spark).columns
    ids = sorted(r[0] for r in kept.filter("doc_id is not null").collect())
    assert ids == sorted(d for d, (_, c) in want.items() if c == d)
    assert minhash_dedup.keep_one(odd.empty(spark)).count() == 0


def test_one_row_of_copies_is_kept(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a, 0), (1, a, 0), (1, c, 0), (2, a, 0), (None, a, 1), (None, b, 2), (None, b, 2), (None, b.upper(), 2)]
    rows += [(None, None, 3), (None, "", 4), (None, "", 4), (5, None, 5), (5, None, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = sorted(((r["doc_id"] or 0, r["n"]) for r in minhash_dedup.keep_one(table).collect()))
    assert kept == [(0, 2), (0, 3), (0, 4), (0, 4), (1, 0), (1, 0), (5, 5)]


def test_index_radius():
    """Signatures that differ in fewer than 2 * chunks symbols agree in a chunk but for one symbol."""
    index = minhash_dedup.index_for(85)
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 2**16, index.symbols)
        b = a.copy()
        b[rng.permutation(index.symbols)[: 2 * index.chunks - 1]] += 1
        wrong = (a != b).reshape(index.chunks, index.width).sum(axis=1)
        assert wrong.min() <= 1
    with pytest.raises(ValueError):
        minhash_dedup.index_for(20)


@pytest.mark.parametrize("percent", [50, 80, 85, 99, 100])
def test_distances_that_pairs_at_the_threshold_exceed(percent):
    index, p = minhash_dedup.index_for(percent), 1 - Fraction(percent, 100)
    for n, most in ((index.symbols, index.max_distance), (index.finer, index.max_finer)):
        tail = lambda k: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1, n + 1))  # noqa: E731, B023
        assert tail(most) <= 1e-7 and (most == 0 or tail(most - 1) > 1e-7)


def test_components_of_a_path(spark):
    rng = random.Random(1)
    ids = list(range(200))
    rng.shuffle(ids)
    links = list(zip(ids[:-1], ids[1:], strict=True))
    rng.shuffle(links)
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"] for r in found} == set(range(1, 200)) and {r["component"] for r in found} == {0}


# Byte strings


def test_suffix_query(spark):
    got = by_id(QUERIES["op2_suffix_dedup"](spark, SMALL), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix_dedup(documents())


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(2)
    for _ in range(200):
        runs = [
            sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 9))})
            for _ in range(rng.randint(1, 7))
        ]
        coded = [suffix_dedup.front_decode(*suffix_dedup.front_code(r)) for r in runs]
        at, out = [0] * len(runs), []
        for run, length, shared in suffix_dedup.merge(coded):
            s = runs[run][at[run]]
            at[run] += 1
            assert length == len(s) and (not out or shared == suffix_dedup.common(out[-1], s))
            out.append(s)
        assert out == sorted(x for r in runs for x in r)


def test_anchors_are_shared():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, 400, dtype=np.uint8)
    other = np.concatenate([rng.integers(97, 123, 37, dtype=np.uint8), text[100:200], rng.integers(97, 123, 90, dtype=np.uint8)])
    at, one = suffix_dedup.anchors(text, np.array([0, 400]), 100)
    there, two = suffix_dedup.anchors(other, np.array([0, len(other)]), 100)
    assert {(p - 100, h) for p, h in zip(at.tolist(), one.tolist(), strict=True) if 100 <= p <= 150} & {
        (p - 37, h) for p, h in zip(there.tolist(), two.tolist(), strict=True) if 37 <= p <= 87
    }


def planted(rng, n, letters):
    """Texts with passages of all lengths around the limits, repeated within and across documents."""
    make = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [make(rng.randint(20, 260)) for _ in range(8)]
    docs = []
    for d in range(n):
        parts = [make(rng.randint(0, 60)) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randint(1, 7))]
        docs.append((d * 3, "".join(parts)))
    return docs + [(n * 3 + 1, make(40) * 9), (n * 3 + 2, "z" * 500), (n * 3 + 4, "z" * 120), (n * 3 + 5, docs[0][1])]


@pytest.mark.parametrize("letters", ["ab", "abcdefghé ", "a"])
def test_suffix_planted(spark, letters):
    docs = planted(random.Random(len(letters)), 60, letters)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = by_id(suffix_dedup.suffix_dedup(table), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix_dedup(docs)


def test_copies_are_settled_before_the_exchange():
    """Of equal anchors and suffixes in a task one goes to the part of its key; the others are answered there."""
    n, text = 1000, b"q" * 151
    ids, tks = np.arange(n)[::-1].copy(), np.zeros(n, np.int64)
    key = np.full(n, 77, np.uint64)
    held = [(ids, tks, np.arange(n), np.full(n, 5, np.uint32), key, key, np.zeros(n, bool))]
    names = [(n - i, 0) for i in range(n)]
    suffixes = [(text, i, 5) for i in range(n)] + [(text, n - 1, 5), (b"r" * 60, 0, 9)]
    anchors_sent = repeats._pack(held, 4, True).to_pylist()
    suffixes_sent = suffix_dedup._sorted_runs(suffixes, names, 50, 151, 4).to_pylist()
    assert sum(len(r["rows"]) for r in anchors_sent if r["bucket"] is None) == repeats.ROW_BYTES
    assert sum(len(r["place"]) for r in suffixes_sent if r["bucket"] is None) == 2 * 4
    for sent, marks in ((anchors_sent, {5 << 1 | repeats.SHARED}), (suffixes_sent, {5 << 8 | 152})):
        found = [m for r in sent if r["bucket"] is not None for m in np.frombuffer(r["marks"], "<u8").tolist()]
        assert len(found) == n - 1 and set(found) == marks


def test_suffix_copies_and_repeated_rows(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh") for _ in range(400))
    docs = [(d, f"{d} " * (d % 7) + passage[d % 3 :] + f" {d}") for d in range(60)]
    docs += [(90, "zy" * 70 + passage[:140]), (91, passage[250:])]
    lone = (99, "".join(rng.choice("abcdefgh") for _ in range(300)))
    for parts in (1, 5):
        table = spark.createDataFrame(docs + [docs[7], docs[0], lone, lone], "doc_id long, text string").repartition(parts)
        got = by_id(suffix_dedup.suffix_dedup(table), "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == brute.suffix_dedup([*docs, lone])


def test_suffix_odd(spark):
    got = by_id(suffix_dedup.suffix_dedup(odd.docs(spark), with_text=True), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = brute.suffix_dedup(odd.pairs())
    assert got == want
    assert suffix_dedup.suffix_dedup(odd.empty(spark)).count() == 0
    kept = suffix_dedup.suffix_dedup(odd.docs(spark), with_text=True).filter("doc_id = 8").first()["kept"]
    assert brute.sha(bytes(kept)) == want[8][3] and len(kept) == want[8][0] - want[8][1] < 200


# Word windows


def test_substring_query(spark):
    got = by_id(QUERIES["op8_substring_dedup"](spark, SMALL), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring_dedup(documents())


@pytest.mark.parametrize("vocabulary", [2, 50, 5000])
def test_substring_planted(spark, vocabulary):
    rng = random.Random(vocabulary)
    make = lambda k: [f"v{rng.randrange(vocabulary)}" for _ in range(k)]
    passages = [make(rng.randint(5, 45)) for _ in range(8)]
    docs = []
    for d in range(80):
        parts = [make(rng.randint(0, 9)) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randint(1, 6))]
        docs.append((d * 2, "\n ".join(w for p in parts for w in p)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = by_id(substring_dedup.substring_dedup(table), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring_dedup(docs)


def test_substring_odd(spark):
    got = by_id(substring_dedup.substring_dedup(odd.docs(spark)), "n_words", "n_removed", "kept_sha256")
    want = brute.substring_dedup(odd.pairs())
    assert got == want
    assert substring_dedup.substring_dedup(odd.empty(spark)).count() == 0
    texts = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(odd.docs(spark), with_text=True).collect()}
    assert want[6][1] == 60 and texts[6] == "more" and texts[1] == "" and texts[5] == ""


def test_cover_aligns_every_distance():
    for distance in range(substring_dedup.PERIOD):
        assert any((a - b) % substring_dedup.PERIOD == distance for a in substring_dedup.COVER for b in substring_dedup.COVER)


# Hashing


def test_span_hashes_do_not_depend_on_place():
    import pyarrow as pa

    texts = ["alpha beta", None, "", "beta  alphaé beta", " beta " + "x" * 600_000]
    found = []
    for _, offsets, data in hashing.text_pieces(pa.array(texts)):
        starts, ends, first = hashing.word_spans(data, offsets)
        hashes = hashing.span_hashes(data, starts, ends)
        found += [hashes[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert [len(f) for f in found] == [2, 0, 0, 3, 2]
    assert found[0][1] == found[3][0] == found[3][2] == found[4][0] and found[0][0] != found[3][1]


def swapped(n):
    """Two different strings of ``2 ** n`` letters on which every polynomial hash modulo 2^64 with an odd base agrees."""
    s = "a"
    for _ in range(n):
        s += s.translate({97: "b", 98: "a"})
    return s, s.translate({97: "b", 98: "a"})


def test_long_words_that_polynomials_confuse(spark):
    one, two = swapped(11)
    rest = " ".join(f"r{i}" for i in range(12))
    docs = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"w {rest}"), (4, f"{one} {rest}")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = by_id(substring_dedup.substring_dedup(table), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring_dedup(docs) and [got[d][1] for d in (1, 2, 3, 4)] == [0, 0, 0, 13]
    got = by_id(minhash_dedup.near_duplicates(table, 100), "n_shingles", "component_id")
    assert got == brute.near_duplicates(docs, 100) and got[2][1] == 2 and got[4][1] == 1


def test_span_hashes_are_one_to_one():
    rng = random.Random(9)
    spans = sorted({bytes(rng.randrange(256) for _ in range(rng.randrange(1, 20))) for _ in range(3000)} | {b"\0" * k for k in range(1, 30)})
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    starts = ends - [len(s) for s in spans]
    hashes = hashing.span_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(spans)
    for k in (0, 7, len(spans) - 1):
        alone = np.frombuffer(spans[k], np.uint8)
        assert hashing.span_hashes(alone, np.array([0]), np.array([len(alone)]))[0] == hashes[k]
    upper, lower = (np.frombuffer(s, np.uint8) for s in (b"AbZ[\xc3\x89", b"abz[\xc3\x89"))
    whole = np.array([0]), np.array([6])
    assert hashing.span_hashes(upper, *whole, lower=True) == hashing.span_hashes(lower, *whole)


def test_text_ids(spark):
    table = spark.createDataFrame([("x", "a b c")], "doc_id string, text string")
    for operator in (suffix_dedup.suffix_dedup, substring_dedup.substring_dedup):
        with pytest.raises(TypeError, match="whole number"):
            operator(table)
    assert minhash_dedup.near_duplicates(table).count() == 1


def test_one_of_repeated_rows_stays_whatever_the_order(spark):
    rows = [(1, "a b c", s) for s in ("z", "m", None, "b")] + [(None, "q r", s) for s in ("y", "x")]
    kept = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(seed + 1)
        kept.add(tuple(sorted((r[0] is None, r[2] or "") for r in minhash_dedup.keep_one(table).collect())))
    assert len(kept) == 1 and len(kept.pop()) == 2
