"""Every stage of the pipeline against a plain version of it."""

from __future__ import annotations

import re

import numpy as np
import pyarrow.parquet as pq
from llm import brute, odd
from llm.conftest import SMALL
from llm.test_filters import check_packing

import corpus_pipeline
from solvelake.llm import packing


def plain_quality(docs):
    def failed(text):
        w = (text or "").encode().split()
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = {g for g in grams if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
        hit = {i + k for i, g in enumerate(grams) if g in twice for k in range(8)}
        return len(w) < 20 or 100 * len(hit) > 30 * len(w)

    bad = {d["doc_id"]: failed(d["text"]) for d in docs}
    hosts = {}
    for d in docs:
        hosts.setdefault(d["source"], []).append(bad[d["doc_id"]])
    rates = np.array([np.mean(v) for v in hosts.values()])
    mean, var = rates.mean(), rates.var()
    strength = mean * (1 - mean) / var - 1 if 0 < var < mean * (1 - mean) else 0
    gone = {h for h, v in hosts.items() if (sum(v) + mean * strength) / (len(v) + strength) > 0.5}
    return [d for d in docs if not bad[d["doc_id"]] and d["source"] not in gone]


def plain_lines(docs):
    texts = brute.line_dedup([(d["doc_id"], d["source"], d["text"]) for d in docs])
    return [d | {"text": texts[d["doc_id"]], "n_chars": len(texts[d["doc_id"]])} for d in docs]


def plain_near(docs):
    found = brute.near_duplicates([(d["doc_id"], d["text"]) for d in docs], 80)
    return [d for d in docs if found[d["doc_id"]][1] == d["doc_id"]]


def plain_clean(docs, items):
    upper = {c: c + 32 for c in range(65, 91)}
    words = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(upper)) if w]
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[i : i + 13]) for i in range(max(len(w) - 12, 1)) if w}
    kept = []
    for d in docs:
        w, hit = words(d["text"]), set()
        for n in {len(x) for x in windows}:
            hit |= {i + k for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(n)}
        if not hit or 20 * len(hit) < len(w):
            kept.append(d)
    return kept


def test_stages(spark):
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    items = pq.read_table(f"{SMALL}/benchmark.parquet")["text"].to_pylist()
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    plain = [plain_quality, plain_lines, plain_near, lambda d: plain_clean(d, items)]
    assert len(corpus_pipeline.STAGES) == 5
    for (name, stage), check in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        out = stage(spark, table, SMALL)
        assert out.columns == table.columns, name
        docs = check(docs)
        got = sorted((r.asDict() for r in out.collect()), key=lambda r: r["doc_id"])
        assert got == sorted(docs, key=lambda r: r["doc_id"]), name
        table = spark.createDataFrame([tuple(d.values()) for d in docs], table.schema)
    rows = corpus_pipeline.STAGES[-1][1](spark, table, SMALL).collect()
    check_packing(rows, [(d["doc_id"], d["text"]) for d in docs], packing.public_byte_bpe())
    whole = corpus_pipeline.run(spark, SMALL).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, rows))


def test_stages_odd(spark):
    for table in (odd.docs(spark), odd.empty(spark)):
        n = table.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SMALL)
            assert out.columns == table.columns and out.count() <= n
        assert (corpus_pipeline.STAGES[-1][1](spark, table, SMALL).count() > 0) == (n > 0)
