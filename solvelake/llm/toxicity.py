"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvelake.llm.base import held_out, store
from solvelake.llm.labels import sample, trainable

GROUP_CHARS, GROUP_TEXTS = 1 << 18, 64
SPACE = re.compile(r"\s")


@dataclass
class Settings:
    orders: tuple[int, ...] = (4, 5, 6)
    bits: int = 18
    #: About how many labelled texts of each class are learned from: the bound of the training sample.
    per_class: int = 2000
    rounds: int = 80
    rate: float = 0.1
    ridge: float = 1e-3
    #: Texts that the smoothing counts for in each class.
    smoothing: float = 20.0
    #: Standard errors that the shares of an n-gram in the two classes must lie apart for it to count.
    certainty: float = 4.0


@dataclass
class ToxicityModel:
    """``weights`` by bucket, the ratios multiplied in."""

    weights: np.ndarray
    bias: float
    settings: Settings = field(default_factory=Settings)


def _cut(text: str, overlap: int) -> list[tuple[str, bool, bool]]:
    """The text in parts of about ``GROUP_CHARS`` characters, cut at white space where there is some.

    Otherwise the cut is inside a word: the next part begins ``overlap`` characters earlier, and both parts are marked
    as open there (at their start, at their end), which makes no edge of a word.
    """
    parts, at, open_ = [], 0, False
    while len(text) - at > GROUP_CHARS + overlap:
        gap = SPACE.search(text, at + GROUP_CHARS, at + 2 * GROUP_CHARS)
        end = gap.end() if gap else min(at + 2 * GROUP_CHARS, len(text))
        inside = not gap and end < len(text)
        parts.append((text[at:end], open_, inside))
        if end == len(text):
            return parts
        at, open_ = end - overlap * inside, inside
    return [*parts, (text[at:], open_, False)]


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and (size + len(t) > GROUP_CHARS or i - first >= GROUP_TEXTS):
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def presence(texts: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket), ascending, of the n-grams that stand in each text, once each.

    N-grams are of lower-cased words with a space on either side, and don't go beyond them.
    """
    if len(texts) == 1 and len(texts[0]) > 2 * GROUP_CHARS:
        parts = _cut(texts[0].lower(), max(settings.orders) - 1)
        bucket = np.unique(np.concatenate([_presence([part], settings, *open_)[1] for part, *open_ in parts]))
        return np.zeros(len(bucket), np.int64), bucket
    return _presence(texts, settings)


def _presence(
    texts: list[str], settings: Settings, open_start: bool = False, open_end: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    bits, before, after = settings.bits, " " * (not open_start), " " * (not open_end)
    joined = "\0".join(before + " ".join(t.lower().replace("\0", " ").split()) + after for t in texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    stop = codes == 0
    text = np.cumsum(stop) - stop
    edge = codes == 32
    seen = np.zeros(len(texts) << bits, bool)
    for order in settings.orders:
        n = len(codes) - order + 1
        if n <= 0:
            continue
        acc = np.full(n, order, np.uint64)
        crossed = np.zeros(n, bool)
        for k in range(order):
            acc = (acc ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(29)
            crossed |= stop[k : k + n]
            if 0 < k < order - 1:
                crossed |= edge[k : k + n]
        bucket = (acc * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)
        seen[((text[:n] << bits) + bucket)[~crossed]] = True
    cell = np.flatnonzero(seen)
    return cell >> bits, cell & ((1 << bits) - 1)


def _featured(rows: DataFrame, settings: Settings) -> DataFrame:
    """``label``, ``weight`` and the buckets of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out = []
            for _, group in _groups(texts):
                row, bucket = presence(group, settings)
                edges = np.searchsorted(row, np.arange(len(group) + 1))
                out += [bucket[a:b].astype("<i4").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("weight"), pa.array(out, pa.binary())],
                names=["label", "weight", "buckets"],
            )

    return rows.select("label", "weight", "text").mapInArrow(run, "label int, weight double, buckets binary")


def log_count_ratios(counts: np.ndarray, texts: np.ndarray, settings: Settings) -> np.ndarray:
    """The ratio of each bucket: ``counts`` (class, bucket) are the texts of a class that have it, of ``texts`` in all.

    Shares are smoothed towards the share of all texts that have the bucket, and 0 stands where the shares of the two
    classes do not lie apart for certain: the many n-grams of a few texts mean nothing, whatever class they are of.
    """
    everywhere = counts.sum(axis=0) / max(texts.sum(), 1)
    shares = (counts + settings.smoothing * everywhere + 1e-9) / (texts[:, None] + settings.smoothing)
    spread = np.sqrt(everywhere * (1 - everywhere) * (1 / np.maximum(texts, 1)).sum() + 1e-12)
    apart = np.abs(counts[1] / max(texts[1], 1) - counts[0] / max(texts[0], 1)) / spread
    return np.where(apart >= settings.certainty, np.log(shares[1] / shares[0]), 0)


def train(
    buckets: list[np.ndarray], label: np.ndarray, weight: np.ndarray, ratio: np.ndarray, settings: Settings
) -> ToxicityModel:
    """Logistic regression on presence times log-count ratio, by full gradients with momentum and step scaling.

    ``buckets`` need hold those with a ratio only. Without texts of both classes, or without such buckets, every text
    gets the smoothed share of label 1.
    """
    total = weight.sum()
    share = (weight[label == 1].sum() + 1) / (total + 2) if len(label) else 0.5
    bias = float(np.log(share / (1 - share)))
    weights = np.zeros(len(ratio), np.float32)
    used = np.flatnonzero(ratio)
    if not len(used) or not ((label == 1).any() and (label == 0).any()):
        return ToxicityModel(weights, bias, settings)
    at = np.full(len(ratio), -1, np.int32)
    at[used] = np.arange(len(used))
    rows = [i[i >= 0] for i in (at[b] for b in buckets)]
    lengths = np.array([len(r) for r in rows])
    full = lengths > 0
    index = np.concatenate(rows)
    starts = (np.cumsum(lengths) - lengths)[full]
    own, size = ratio[used], len(used)
    weight = weight / total
    w, mean, square = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, settings.rounds + 1):
        z = np.full(len(label), bias)
        if len(starts):
            z[full] += np.add.reduceat((own * w)[index], starts)
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label)
        gradient = own * np.bincount(index, np.repeat(slope, lengths), size) + settings.ridge * w
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        pace = settings.rate / np.sqrt(1 + step / 20)
        w -= pace * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        bias -= pace * float(slope.sum())
    weights[used] = own * w
    return ToxicityModel(weights, bias, settings)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings()) -> ToxicityModel:
    """Learn from a bounded sample of the labelled rows that are not held out (``settings.per_class``).

    Rows of the sample stand for all rows of their class, so that scores keep to the share of the whole table.
    """
    known = trainable(labels.select("doc_id", F.col(label).cast("int").alias("label")).dropDuplicates(["doc_id"]))
    chosen = sample(known, "label", settings.per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by the sample
    table, _ = store(_featured(rows, settings), "toxic-sample")
    # The sample comes one partition at a time, first to count and then for the buckets that matter alone.
    counts, texts = np.zeros((2, 1 << settings.bits)), np.zeros(2)
    for r in table.toLocalIterator():
        counts[r["label"], np.frombuffer(r["buckets"], "<i4")] += 1
        texts[r["label"]] += 1
    ratio = log_count_ratios(counts, texts, settings)
    buckets, label, weight = [], [], []
    for r in table.toLocalIterator():
        own = np.frombuffer(r["buckets"], "<i4")
        buckets.append(own[ratio[own] != 0])
        label.append(r["label"])
        weight.append(r["weight"])
    return train(buckets, np.array(label, np.int64), np.array(weight, np.float64), ratio, settings)


def scores(texts: list[str], model: ToxicityModel) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    for first, group in _groups(texts):
        row, bucket = presence(group, model.settings)
        out[first : first + len(group)] += np.bincount(row, model.weights[bucket], len(group))
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score``, ``predicted`` (1 from ``threshold`` on).

    Only the text is read. Null and empty texts have no n-grams and get the score of the bias.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores(texts, shared.value))], names=["doc_id", "score"]
            )

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3, settings: Settings = Settings()
) -> DataFrame:
    """Learn from ``labels`` (doc_id, ``label``) and score each row of ``docs``; see ``fit`` and ``score``."""
    return score(docs, fit(docs, labels, label, settings), threshold)
