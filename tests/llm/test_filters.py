"""Quality rules, line dedup, decontamination and packing: SQL, plain versions, and edge cases."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from llm import brute, odd
from llm.conftest import SMALL, documents

from solvelake.llm import decontaminate, line_dedup, packing, quality_rules
from solvelake.llm.queries import ORACLES, QUERIES

NATIVE = ("op6_decontamination", "op9_quality_rules")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    got = oracle.rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    assert got == oracle.rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", NATIVE)
def test_native(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin") if w in plan]


# Quality rules


def rules(spark, texts, **options):
    table = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    return {r["doc_id"]: r for r in quality_rules.quality_rules(table, **options).collect()}


def test_rule_counts(spark):
    eight = "a b c d e f g h"
    got = rules(spark, [f"{eight} {eight}", f"{eight} x {eight} y", "a " * 30, "# $x\n# $x\n \n \n# $x ", "é𝄞 \x0b z", eight])
    assert [got[i]["n_repeat_words"] for i in range(6)] == [16, 16, 30, 0, 0, 0]
    assert got[3]["n_dup_lines"] == 1 and got[3]["n_symbols"] == 6
    assert got[4]["n_words"] == 2 and got[4]["word_chars"] == 3
    assert [got[i]["base_failed"] for i in range(6)] == [True] * 6


def test_host_verdict(spark):
    good, bad = " ".join(f"u{i}" for i in range(40)), "few"
    rows = [(i, good, "fine") for i in range(30)] + [(100 + i, bad, "spam") for i in range(28)]
    rows += [(200, good, "spam"), (201, good, "spam"), (300, good, None), (301, bad, "fine"), (302, good, "mixed"), (303, bad, "mixed")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(table).filter("kept").collect()}
    assert {200, 201} & kept == set() and 300 in kept and set(range(30)) <= kept and 301 not in kept
    verdicts = {r["host"]: r for r in quality_rules.host_verdicts(quality_rules.document_rules(table), "source").collect()}
    spam = verdicts["spam"]
    assert 0.5 < spam["host_failure"] < spam["failures"] / spam["pages"]
    assert verdicts["mixed"]["host_failure"] < 0.5


def test_rules_odd(spark):
    got = quality_rules.quality_rules(odd.docs(spark)).collect()
    assert len(got) == len(odd.rows())
    assert all(r["n_words"] == len((t or "").encode().split()) for d, t in odd.pairs() for r in got if r["doc_id"] == d)
    assert quality_rules.quality_rules(odd.empty(spark)).count() == 0
    kept = quality_rules.keep_documents(odd.docs(spark))
    assert kept.columns == odd.docs(spark).columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(
        r["doc_id"] for r in got if r["kept"] and r["doc_id"] is not None
    )
    assert quality_rules.keep_documents(odd.empty(spark)).count() == 0


# Lines


def test_lines(spark):
    rows = [(i, "a" if i % 3 else "b", f"menu {i % 2}\n own {i}\n\n menu x \t") for i in range(90)] + [
        (100, "c", "menu x"), (101, None, "menu x\nq"), (102, None, None), (103, "a", ""), (104, "b", "menu x\nmenu x")
    ]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(table).collect()}
    assert got == brute.line_dedup(rows)
    assert got[1] == " own 1\n" and got[100] == "menu x" and got[102] is None and got[104] == ""


def test_lines_odd(spark):
    got = line_dedup.line_dedup(odd.docs(spark))
    assert got.count() == len(odd.rows()) and set(odd.docs(spark).columns) <= set(got.columns)
    texts = Counter(r["text"] for r in got.collect())
    assert texts == Counter(r[1] for r in odd.rows())
    assert line_dedup.line_dedup(odd.empty(spark)).count() == 0


# Benchmarks


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "item_id long, text string")


def test_windows_and_spans(spark):
    long = [f"q{i}" for i in range(20)]
    items = bench(spark, [" ".join(long), "Short one", None, "", "...", "Short  ONE"])
    texts = [
        "x " + " ".join(long[2:16]).upper() + ". y", "a short-one b", "shorts one", " ".join(long[:12]), None, "",
        "short one " + "z " * 60, "!short one, end", " ".join(long * 2),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (100_000, 0):
        got = {r["doc_id"]: r for r in decontaminate.contamination(docs, items, set_limit=limit).collect()}
        assert [got[i]["n_hit"] for i in range(9)] == [14, 2, 0, 0, 0, 0, 2, 2, 40]
        assert got[1]["items"] == ["2", "6"] and got[0]["items"] == ["1"]
        assert [got[i]["contaminated"] for i in range(9)] == [True, True, False, False, False, False, False, True, True]
        left = {r["doc_id"] for r in decontaminate.decontaminate(docs, items, set_limit=limit).collect()}
        assert left == {2, 3, 4, 5, 6}
    spans = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items, remove="spans").collect()}
    assert spans[0] == "x y" and spans[1] == "a b" and spans[7] == "!end" and spans[8] == "" and spans[2] == "shorts one"
    assert spans[6] == "z " * 60 and spans[4] is None


def test_large_benchmark(spark):
    """200,000 windows, in one set of hashes and in shares, against plain sets of windows."""
    draw = random.Random(5)
    items = {f"i{n}": [f"w{draw.randrange(5000)}" for _ in range(413)] for n in range(500)}
    items["short"], items["again"] = ["only", "five", "words", "of", "it"], items["i7"][:200]
    texts = []
    for n in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(0, 300))]
        if n % 3 == 0:
            start = draw.randrange(380)
            words[20:20] = items[f"i{n}"][start : start + draw.randrange(10, 60)]
        texts.append(words + (items["short"] if n % 7 == 0 else []))
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    bench_ = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id string, text string")
    grams = {}
    for name, words in items.items():
        size = min(13, len(words))
        for i in range(len(words) - size + 1):
            grams.setdefault(tuple(words[i : i + size]), set()).add(name)
    assert len(grams) > 200_000
    want = {}
    for n, words in enumerate(texts):
        at = [(i, size) for size in (5, 13) for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in grams]
        hit = {j for i, size in at for j in range(i, i + size)}
        names = set().union(*(grams[tuple(words[i : i + size])] for i, size in at))
        want[n] = (len(words), len(hit), sorted(names))
    assert len([1 for w in want.values() if w[1]]) > 20
    for limit in (decontaminate.PER_PASS, 70_000):
        rows = decontaminate.contamination(docs, bench_, set_limit=limit).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in rows} == want


def test_contamination_odd(spark):
    items = bench(spark, [odd.BASE, None])
    got = decontaminate.contamination(odd.docs(spark), items).collect()
    assert len(got) == len(odd.rows())
    assert {r["doc_id"] for r in got if r["contaminated"]} == {4, 5, 6, -3, None}
    kept = decontaminate.decontaminate(odd.docs(spark), items)
    assert kept.columns == odd.docs(spark).columns and kept.count() == len(odd.rows()) - 6
    assert decontaminate.decontaminate(odd.empty(spark), items).count() == 0
    none = items.filter("item_id < 0")
    assert decontaminate.decontaminate(odd.docs(spark), none).count() == len(odd.rows())
    assert not [r for r in decontaminate.contamination(odd.docs(spark), none).collect() if r["n_hit"]]


# Packing


def check_packing(rows, docs, encode):
    """Every id of every document in one piece, sequences gapless and of 1024 ids at most, checksums of the ids."""
    ids = {d: np.append(encode([t or ""])[0], 0).astype("<u4") for d, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        data = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and len(data) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(data.tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for d, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[d])
    lengths = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        lengths.append(at)
    # Little padding: a hundredth, beside what the last sequences of a small corpus need.
    assert packing.padding(lengths) <= 0.01 * sum(lengths) + 2 * 1024
    return packing.padding(lengths) / sum(lengths)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_packing_query(spark, sf):
    rows = QUERIES["op10_packing"](spark, f"/root/testdata/{sf}").collect()
    check_packing(rows, documents(f"/root/testdata/{sf}"), packing.public_byte_bpe())


def test_encoder_equals_tokenizers():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    every = ["".join(map(chr, range(a, a + 16))) + f" {chr(a)}{chr(a)} x{chr(a)}1" for a in range(0, 0x250, 8)]
    texts = [t for _, t in documents()] + every + [
        "", "a<|endoftext|>b", "<|endoftext|>", "  two  spaces \n\n\t end ", "中文 ภาษา 😀 é", "x" * 5000, "don't I'LL we've", " "
    ]
    fast = packing.public_byte_bpe()(texts)
    assert [x.tolist() for x in fast] == [slow.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_white_space(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    n = 1_100_000
    texts = [" " * n, "\n" * n, "a b" + " \n\t" * (n // 3) + "c <|endoftext|> d", "x" + " " * 999_000 + "y"]
    encode = packing.public_byte_bpe()
    for text, ids in zip(texts, encode(texts), strict=True):
        assert np.array_equal(ids, slow.encode(text, add_special_tokens=False).ids)
    docs = [*enumerate(texts[:2]), (2, "a short text")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    check_packing(packing.pack_documents(table).collect(), docs, encode)


def test_shortest_pack_first():
    assert packing.shortest_pack_first({}, 8) == []
    assert sorted(packing.shortest_pack_first({8: 2, 5: 1, 3: 1}, 8)) == [([5, 3], 1), ([8], 2)]
    patterns = packing.shortest_pack_first({3: 5}, 8)
    assert sum(n * p.count(3) for p, n in patterns) == 5 and max(sum(p) for p, _ in patterns) <= 8
    rng = np.random.default_rng(0)
    counts = {int(k): int(v) for k, v in zip(range(1, 1025), rng.integers(0, 10**7, 1024), strict=True) if v}
    patterns = packing.shortest_pack_first(counts, 1024)
    placed = Counter()
    for lengths, n in patterns:
        for length in lengths:
            placed[length] += n
    assert placed == counts and max(sum(p) for p, _ in patterns) <= 1024 and len(patterns) < 20_000
    assert sum((1024 - sum(p)) * n for p, n in patterns) < 0.01 * sum(k * v for k, v in counts.items())


def word_lengths():
    """An encoder that workers get by value."""

    def make():
        return lambda texts: [np.array([len(w) for w in t.split()], np.uint32) for t in texts]

    return make


def test_packing_odd(spark):
    table = packing.pack_documents(odd.docs(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]), word_lengths())
    check_packing(table.collect(), odd.pairs(), word_lengths()())
    everything = packing.pack_documents(odd.docs(spark), word_lengths(), with_ids=True).collect()
    assert sum(r["start"] == 0 for r in everything) == len(odd.rows())
    assert all(len(r["ids"]) == 4 * r["length"] for r in everything)
    assert len({(r["sequence_id"], r["offset"]) for r in everything}) == len(everything)
    assert packing.pack_documents(odd.empty(spark), word_lengths()).count() == 0


def test_ranks_of_a_hot_length(spark):
    table = spark.range(5000).selectExpr("id doc_id", "0L start", "if(id % 3 = 0, 7L, id % 5) length", "id ids_crc32")
    rows = packing.ranked(table, ["doc_id", "start", "ids_crc32"]).collect()
    by_length = defaultdict(list)
    for r in rows:
        by_length[r["length"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by_length.values()) and len(rows) == 5000
