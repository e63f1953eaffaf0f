"""The three classifiers: held-out accuracy, and edge cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from llm import brute, odd
from llm.conftest import SMALL

from solvelake.llm import labels, language_id, quality_classifier, toxicity
from solvelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def judged(spark, name, label):
    rows = QUERIES[name](spark, SF).toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(rows["doc_id"], rows["held_out"], strict=True))
    assert rows["score"].between(0, 1).all()
    known = pq.read_table(f"{SF}/labels.parquet").to_pandas()
    rows = rows[rows["held_out"]].merge(known, on="doc_id")
    return rows, rows[label] == 1


def test_quality_held_out(spark):
    rows, good = judged(spark, "op4_quality_classifier", "quality")
    assert ((rows["predicted"] == 1) == good).mean() > 0.99
    assert (rows["predicted"] == (rows["score"] >= 0.7)).all()


def test_language_held_out(spark):
    rows = QUERIES["op5_language_id"](spark, SF).toPandas()
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pandas()
    rows = rows[rows["held_out"]].merge(docs, on="doc_id")
    assert (rows["lang_pred"] == rows["lang"]).mean() > 0.99
    assert rows["score"].between(0, 1).all()


def test_toxicity_held_out(spark):
    rows, toxic = judged(spark, "op7_toxicity", "toxic")
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all()
    found = rows["predicted"] == 1
    assert (found & toxic).sum() > 0.8 * toxic.sum() and (found & ~toxic).sum() < 0.05 * (~toxic).sum()
    rank = rows["score"].rank()
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.95


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, weight int")


LABELS = [(d, d % 2, d % 3 == 0, "x", 1) for d in (-3, 2, 4, 5, 6, 7, 8, 9, 10, 11)]
ODD_LABELS = [*[(d, q, int(t), x, w) for d, q, t, x, w in LABELS], (None, 1, 1, None, 1), (1, None, None, None, None), (5, 1, 0, "", 2)]


@pytest.mark.parametrize("rows", [ODD_LABELS, []])
def test_classifiers_odd(spark, rows):
    known = labelled(spark, rows)
    for out in (quality_classifier.quality(odd.docs(spark), known), toxicity.toxicity(odd.docs(spark), known)):
        got = out.collect()
        assert len(got) == len(odd.rows()) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
        same = {r["score"] for r in got if r["doc_id"] == 4}
        assert len(same) == 1
    for run in (quality_classifier.quality, toxicity.toxicity):
        assert run(odd.empty(spark), known).count() == 0


def test_language_odd(spark):
    got = {r["doc_id"]: r for r in language_id.language_id(odd.docs(spark)).collect()}
    assert len(language_id.language_id(odd.docs(spark)).collect()) == len(odd.rows())
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[1]["score"] == 0
    assert got[7]["lang_pred"] in ("en", "de", "fr")
    assert language_id.language_id(odd.empty(spark)).count() == 0
    nothing = language_id.fit(odd.empty(spark))
    assert {r["lang_pred"] for r in language_id.identify(odd.docs(spark), nothing).collect()} == {"und"}


def test_scores_ignore_other_columns(spark):
    texts = spark.createDataFrame([(i, "der die das und nicht ein" if i % 2 else "the and of that is") for i in range(80)], "doc_id long, text string")
    docs = texts.selectExpr("*", "if(doc_id % 2 = 1, 'de', 'en') lang")
    model = language_id.fit(docs)
    plain = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(texts, model).collect()}
    assert plain == {i: "de" if i % 2 else "en" for i in range(80)}


def test_sample_is_bounded_and_stable(spark):
    rows = spark.range(20_000).selectExpr("id doc_id", "if(id % 10 = 0, 1, 0) label")
    one = labels.sample(rows, "label", 500).collect()
    two = labels.sample(rows.repartition(7), "label", 500).collect()
    assert sorted(one) == sorted(two)
    for value, n in ((0, 18_000), (1, 2_000)):
        picked = [r for r in one if r["label"] == value]
        assert 400 < len(picked) < 600 and abs(sum(r["weight"] for r in picked) - n) < 0.2 * n


def test_sparse_scores_equal_dense():
    model = language_id.LanguageModel(["a", "b"], np.log([0.4, 0.6]), np.log(np.random.default_rng(1).random((1 << 8, 2))).astype(np.float32), (1, 2), 8)
    texts = ["ab ba abab", "", "zz top", "é"]
    got = language_id.log_likelihoods(model, texts)
    for i, text in enumerate(texts):
        buckets, _ = language_id.ngram_buckets([text], model.orders, model.bits)
        want = model.log_priors + model.log_probs[buckets].astype(float).sum(axis=0)
        assert np.allclose(got[i], want)


def test_trees_find_steps_and_interactions():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    model = quality_classifier.train(x, y, np.ones(len(y)), quality_classifier.Settings())
    p = quality_classifier.predict(model, x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.97 and (0, 1) in [(i, j) for i, j, *_ in model.pairs]


def test_segments_of_long_texts_count_every_ngram_once():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abÉİ ß\n.ΣxYz") for _ in range(n)) for n in (0, 1, 5, 13, 14, 40, 200)]
    whole = [np.bincount(language_id.ngram_buckets([t.lower()], (1, 2, 3), 12)[0], minlength=1 << 12) for t in texts]
    for limit in (3, 7, 13, 1000):
        got = np.zeros((len(texts), 1 << 12), np.int64)
        for rows, parts, leads in language_id.segments(texts, (1, 2, 3), limit):
            buckets, owner = language_id.ngram_buckets(parts, (1, 2, 3), 12, leads)
            np.add.at(got, (np.array(rows)[owner], buckets), 1)
        assert (got == np.array(whole)).all(), limit


def test_parts_of_long_texts_have_the_ngrams_of_the_whole(monkeypatch):
    rng = random.Random(4)
    settings = toxicity.Settings()
    texts = ["".join(rng.choice("abcdÉ" + " " * spaces) for _ in range(n)) for n in (30, 41, 97, 400) for spaces in (0, 1)]
    whole = [toxicity.presence([t], settings)[1].tolist() for t in texts]
    for size in (16, 20, 33):
        monkeypatch.setattr(toxicity, "GROUP_CHARS", size)
        assert [toxicity.presence([t], settings)[1].tolist() for t in texts] == whole


def test_language_query_against_plain_counts(spark):
    """Every prediction and score of the query on the smallest table equals a model counted one n-gram at a time."""
    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text", "lang"])
    want = brute.languages(list(zip(*table.to_pydict().values(), strict=True)))
    got = {r[0]: tuple(r[1:4]) for r in QUERIES["op5_language_id"](spark, SMALL).collect()}
    assert {d: v[:2] for d, v in got.items()} == {d: v[:2] for d, v in want.items()}
    assert all(got[d][2] == pytest.approx(want[d][2], abs=1e-3) for d in want)
