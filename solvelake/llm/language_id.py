"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvelake.llm.base import held_out
from solvelake.llm.labels import trainable

#: Characters of text that are taken together. A longer text is counted segment by segment; each begins with the end of
#: the one before, so that every n-gram is counted once.
CHARS = 1 << 18


def ngram_buckets(
    texts: list[str], orders: tuple[int, ...], bits: int, leads: list[int] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased texts, and the text that each belongs to.

    Characters other than letters count as one kind of gap; n-grams of gaps only, or over the end of a text, are left
    out, and so are those that end within the first ``leads`` characters of their text.
    """
    joined = "\0".join(t.lower().replace("\0", " ") for t in texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(codes == 0)
    unique = np.unique(codes)
    letters = np.array([c if chr(c).isalpha() else 32 for c in unique.tolist()], np.uint32)
    letters[unique == 0] = 0
    codes = letters[np.searchsorted(unique, codes)].astype(np.uint64)
    text = np.searchsorted(ends, np.arange(len(codes)), "left")
    begin = np.append(0, ends[:-1] + 1) + np.array(leads or [0] * len(texts), np.int64)
    counted = np.arange(len(codes)) >= begin[np.minimum(text, len(texts) - 1)]
    buckets, owners = [], []
    for order in orders:
        n = len(codes) - order + 1
        if n <= 0:
            continue
        acc = np.full(n, order, np.uint64)
        broken, gap = np.zeros(n, bool), np.ones(n, bool)
        for k in range(order):
            part = codes[k : k + n]
            acc = (acc ^ part) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(29)
            broken |= part == 0
            gap &= part == 32
        ok = ~(broken | gap) & counted[order - 1 :]
        buckets.append((acc[ok] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64))
        owners.append(text[:n][ok])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def segments(
    texts: list[str], orders: tuple[int, ...], limit: int = CHARS
) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Runs of about ``limit`` characters: texts, or segments of long ones, with the row of each and the number of
    characters that it repeats from the segment before."""
    rows: list[int] = []
    parts: list[str] = []
    leads: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        t = t.lower() if len(t) > limit else t
        for at in range(0, max(len(t), 1), limit):
            if parts and size + len(t) - at > limit:
                yield rows, parts, leads
                rows, parts, leads, size = [], [], [], 0
            lead = min(at, max(orders) - 1)
            rows.append(i)
            parts.append(t[at - lead : at + limit])
            leads.append(lead)
            size += len(parts[-1]) + 1
    if parts:
        yield rows, parts, leads


@dataclass
class LanguageModel:
    """``log_probs``: buckets x languages; ``log_priors``. Languages in ascending order."""

    languages: list[str]
    log_priors: np.ndarray
    log_probs: np.ndarray
    orders: tuple[int, ...]
    bits: int


def fit(
    docs: DataFrame, lang: str = "lang", orders: tuple[int, ...] = (1, 2, 3), bits: int = 16, alpha: float = 0.5
) -> LanguageModel:
    """Learn from every row with a text and a language that is not held out.

    Tasks count n-grams per language and bucket. The model has 2**``bits`` numbers per language, however large the
    corpus; that is what comes to the driver and goes to every task.
    """
    rows = trainable(docs).filter(F.col("text").isNotNull() & F.col(lang).isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for name in langs:
                n[name] = n.get(name, 0) + 1
            for rows, texts, leads in segments(batch.column("text").to_pylist(), orders):
                buckets, owner = ngram_buckets(texts, orders, bits, leads)
                names = sorted({langs[r] for r in rows})
                index = {x: i for i, x in enumerate(names)}
                own = np.array([index[langs[r]] for r in rows])
                flat = np.bincount((own[owner] << bits) + buckets, minlength=len(names) << bits)
                for name, counts in zip(names, flat.reshape(len(names), -1), strict=True):
                    totals[name] = totals.get(name, 0) + counts
        for name, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int64()),
                    pa.array(np.append(counts[at], n[name]), pa.int64()),
                ],
                names=["lang", "bucket", "n"],
            )

    counted = rows.select("text", F.col(lang).cast("string").alias("lang")).mapInArrow(count, "lang string, bucket long, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique().tolist())
    counts = np.zeros((1 << bits, len(languages)))
    documents = np.zeros(len(languages))
    column = table["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)
    bucket, n = table["bucket"].to_numpy(dtype=np.int64), table["n"].to_numpy(dtype=np.float64)
    documents[column[bucket < 0]] = n[bucket < 0]
    counts[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    probs = (counts + alpha) / (counts.sum(axis=0) + alpha * (1 << bits))
    priors = (documents + 1) / (documents.sum() + len(languages)) if languages else documents
    return LanguageModel(languages, np.log(priors), np.log(probs).astype(np.float32), orders, bits)


def log_likelihoods(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Texts x languages: sparse counts of the n-grams of some texts at a time, times the matrix."""
    out = np.tile(model.log_priors, (len(texts), 1))
    for rows, parts, leads in segments(texts, model.orders):
        buckets, owner = ngram_buckets(parts, model.orders, model.bits, leads)
        if not len(buckets):
            continue
        cell, times = np.unique((owner << model.bits) + buckets, return_counts=True)
        row, column = cell >> model.bits, cell & ((1 << model.bits) - 1)
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        scores = model.log_probs[column].astype(np.float64) * times[:, None]
        np.add.at(out, np.array(rows)[row[starts]], np.add.reduceat(scores, starts, axis=0))
    return out


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    ``score`` is the posterior probability of the language. A text that is null, or has no letter, or of which the
    model knows no language, is ``und`` with score 0. Only the text is read. Ties go to the first language in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t))]
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if known:
                logs = log_likelihoods(model, [texts[i] for i in known])
                best = logs.argmax(axis=1)
                top = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                for i, b, p in zip(known, best.tolist(), top.tolist(), strict=True):
                    names[i], scores[i] = model.languages[b], p
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)],
                names=["doc_id", "lang_pred", "score"],
            )

    out = docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def language_id(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """Learn from ``docs`` and identify the language of each row; see ``fit`` and ``identify``."""
    return identify(docs, fit(docs, lang))
