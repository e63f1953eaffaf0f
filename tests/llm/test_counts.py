"""Periodic runs, token counts and the divergence of sources against plain versions, and their edge cases."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm import brute, odd
from llm.conftest import SMALL, documents

from solvelake.llm import perfect_hash, periodic_runs, source_divergence, token_counts
from solvelake.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def key(row):
    return tuple((x is None, x) for x in row)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


# Periodic runs


def test_periodic_runs_query(spark):
    df = QUERIES["op11_periodic_runs"](spark, SMALL)
    assert df.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    ]
    want = [(d, *brute.periodic(d, t, True)) for d, t in documents() if len((t or "").split()) < 1500]
    got = {r[0]: tuple(r) for r in df.collect()}
    assert len(got) == len(documents()) and [got[w[0]] for w in want] == want
    assert sum(w[1] > 0 for w in want) > 10


def test_runs_of_random_words():
    """Few different words, planted powers, runs that touch or share words, and both ends of a document."""
    rng = random.Random(1)
    for _ in range(600):
        k = rng.choice([1, 2, 2, 3, 5])
        w = [b"w%d" % rng.randrange(k) for _ in range(rng.randrange(90))]
        if rng.random() < 0.6:
            p = [b"p%d" % rng.randrange(rng.choice([2, 30])) for _ in range(rng.randrange(1, 25))]
            w = w + p * rng.randrange(1, 6) + p[: rng.randrange(len(p))] + w[:10]
        assert periodic_runs.runs_of_documents([w, [], w[::-1]]) == [brute.runs(w), [], brute.runs(w[::-1])]


def test_long_period_and_islands():
    words = [b"u%d" % i for i in range(5000)]
    tail = [b"t%d" % i for i in range(700)]
    doc = words + tail * 3 + tail[:50] + words[:20]
    assert periodic_runs.runs_of_documents([doc]) == [[(5000, 2150, 700)]]
    numbers = np.arange(5000, dtype=np.uint64)
    assert len(periodic_runs.islands(numbers, np.zeros(5000, np.int64))[0]) == 0


def test_periodic_runs_odd(spark):
    got = tuples(periodic_runs.periodic_runs(odd.docs(spark)))
    short = [(d, t) for d, t, *_ in odd.rows() if len(t or "") < 10_000]
    want = [(d, *brute.periodic(d, t, False)) for d, t in short]
    assert [g for g in got if g[0] not in (7, 8)] == sorted(want, key=key) and len(got) == len(odd.rows())
    assert periodic_runs.periodic_runs(odd.empty(spark)).count() == 0
    text_ids = spark.createDataFrame([("x", "a b " * 20)], "doc_id string, text string")
    assert periodic_runs.periodic_runs(text_ids).first()[:5] == ("x", 1, 0, 40, 2)


# Token counts


def plain(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return [len(x) for x in model.encode(texts, num_threads=1)]


def test_token_counts_query(spark):
    want = [(d, len((t or "").encode()), n, n > 4096) for (d, t), n in zip(documents(), plain([t or "" for _, t in documents()]), strict=True)]
    assert tuples(QUERIES["op12_token_counts"](spark, SMALL)) == sorted(want)


def odd_texts():
    rng = random.Random(2)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = [model.id_to_piece(i) for i in range(259, 32000)]
    for k in range(1200):
        if k % 4 == 0:
            yield "".join(rng.choice(" \n\tab▁0é漢𝄞<s>") for _ in range(rng.randrange(60)))
        elif k % 4 == 1:
            spans = [(32, 127), (0x20, 0x3000), (0x4E00, 0xA000), (0x1F300, 0x1F700)]
            yield "".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(rng.randrange(60)))
        elif k % 4 == 2:
            yield "".join(rng.choice(pieces).replace("▁", rng.choice([" ", "▁", ""])) for _ in range(rng.randrange(30)))
        else:
            yield "".join(rng.choice("abcdeinrst") for _ in range(rng.randrange(400)))
    yield from (" " * 5000, "a" * 20000, "x\0y <s> </s> <unk> <0x0A>", "the " * 3000, "", "\n" * 50)
    yield "".join(rng.choice("abcdefgh012") for _ in range(9000))


@pytest.mark.parametrize(("gather", "long"), [(1 << 20, 1 << 10), (50, 1 << 10), (1 << 20, 8), (7, 1)])
def test_tokens_of_odd_texts(monkeypatch, gather, long):
    """Texts cut into parts, and sequences left to the queue, count the same."""
    monkeypatch.setattr(token_counts, "GATHER", gather)
    monkeypatch.setattr(token_counts, "LONG", long)
    texts = list(odd_texts())
    assert token_counts.count_texts(texts, token_counts.sentencepiece_vocabulary(MODEL), {}) == plain(texts)


def test_vocabulary_with_late_and_missing_pieces():
    """Pieces whose score is better than that of their parts, equal scores, and characters that are no piece."""
    pieces, scores = ["a", "b", "c", "ab", "bc", "abc", "aa", "aaa", "xa"], [-9, -9, -9, -3, -4, -1, -5, -5, -6]
    v = token_counts.vocabulary(pieces, [float(s) for s in scores])
    rank = dict(zip(pieces, scores, strict=True))

    def one_by_one(text):
        parts = list(text)
        while True:
            pairs = [(-rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
            if not pairs:
                return sum(1 if p in rank else len(p.encode()) for p in parts)
            _, i = min(pairs)
            parts[i : i + 2] = ["".join(parts[i : i + 2])]

    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice("aaabcxé") for _ in range(rng.randrange(1, 30)))
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        got = token_counts.count_codes(codes, np.zeros(len(codes), np.int64), 1, v, {})
        assert got.tolist() == [one_by_one(text)], text


def test_token_counts_odd(spark):
    got = tuples(token_counts.token_counts(odd.docs(spark), MODEL, limit=50))
    texts = [r[1] or "" for r in odd.rows()]
    want = [(r[0], len(t.encode()), n, n > 50) for r, t, n in zip(odd.rows(), texts, plain(texts), strict=True)]
    assert got == sorted(want, key=key)
    assert token_counts.token_counts(odd.empty(spark), MODEL).count() == 0


# Divergence of sources


def test_perfect_hash():
    rng = random.Random(5)
    for n in (1, 2, 7, 300, 20_000):
        keys = sorted({b"%d-%s" % (rng.randrange(10**9), b"x" * rng.randrange(9)) for _ in range(n)})
        table = perfect_hash.load(perfect_hash.dump(perfect_hash.build(keys)))
        slots = table.slots(keys, perfect_hash.hash_keys(keys))
        assert sorted(slots.tolist()) == list(range(len(keys)))
        assert [table.key(s) for s in slots.tolist()] == keys
        others = [k + b"?" for k in keys]
        assert set(table.slots(others, perfect_hash.hash_keys(others)).tolist()) == {-1}


def test_perfect_hash_of_equal_hashes(monkeypatch):
    monkeypatch.setattr(perfect_hash, "hash_keys", lambda keys: np.array([len(k) for k in keys], np.uint64))
    keys = [b"a", b"b", b"cc", b"ddd", b"eee"]
    table = perfect_hash.build(keys)
    slots = table.slots([*keys, b"f", b"ee"], perfect_hash.hash_keys([*keys, b"f", b"ee"])).tolist()
    assert sorted(slots[:5]) == [0, 1, 2, 3, 4] and slots[5:] == [-1, -1]
    assert [table.key(s) for s in slots[:5]] == keys


def test_terms_in_parts(monkeypatch):
    monkeypatch.setattr(source_divergence, "SPLIT", 7)
    text = "Ab c, ÉcoleX averyverylongterm\x00\x41ND end 12 " * 3
    want = [t for part in source_divergence.terms(text.encode()) for t in part]
    monkeypatch.undo()
    assert want == next(source_divergence.terms(text.encode()))
    assert want[:6] == [b"ab", b"c", "École".encode().replace(b"E", b"e") + b"x", b"averyverylongterm", b"and", b"end"]


@pytest.mark.parametrize(("shard", "told", "entries", "slots"), [(1 << 14, 48 << 20, 1 << 18, 1 << 22), (16, 2000, 50, 30)])
def test_source_divergence(spark, monkeypatch, shard, told, entries, slots):
    """One shard and many, told at once or in several passes, and tasks that hand on at every batch."""
    for name, value in (("SHARD", shard), ("TOLD", told), ("ENTRIES", entries), ("TERMS", entries), ("SLOTS", slots)):
        monkeypatch.setattr(source_divergence, name, value)
    rng = random.Random(6)
    rows = [
        (rng.choice(["en", "de", None, ""]), rng.choice(["s", "s", "s", "t", "u", None]),
         " ".join(f"{rng.choice('aBcÉ')}{'xyz'[int(rng.random() ** 3 * 3)]}" for _ in range(rng.randrange(30))))
        for _ in range(150)
    ] + [("fr", "s", "rare"), ("fr", "t", None), ("en", "empty", "12"), ("it", "s", "alone")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    got = source_divergence.source_divergence(df, min_docs=12, top=4).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute.divergence(rows, 12, 4)


def test_source_divergence_odd(spark):
    docs = odd.docs(spark)
    for least in (1, 3, 99):
        got = {tuple(r) for r in source_divergence.source_divergence(docs, min_docs=least).collect()}
        assert got == brute.divergence([(r[2], r[3], r[1]) for r in odd.rows()], least, 50)
    out = source_divergence.source_divergence(odd.empty(spark))
    assert out.count() == 0
    assert [t for _, t in out.dtypes] == ["string", "string", "string", "string", "bigint", "int"]


def test_shares_are_exact(spark):
    cases = [(0, 0, 1), (7, 10**14, 10**9), (10**15, 10**15, 1), (3 * 10**12, 8 * 10**15, 10**7)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    got = [r[0] for r in df.select(source_divergence.share(*map(df.__getitem__, "cnv"))).collect()]
    want = [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in cases]
    arrays = source_divergence._shares(np.array([c[0] for c in cases]), np.array([n + 5 * v for _, n, v in cases]))
    assert got == want == arrays.tolist()
