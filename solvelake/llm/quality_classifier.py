"""Quality: a generalised additive model with pairwise interactions, learned by cyclic boosting of shallow trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvelake.llm.base import held_out, store
from solvelake.llm.hashing import grams, span_hashes, text_pieces, word_spans
from solvelake.llm.labels import sample, trainable

#: Bytes whose share of a text is a feature.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".!?",
    "bang": b"!",
    "comma": b",;:",
    "symbol": b"#*$%&|<>",
    "mark": b"\"'()[]{}/\\@^_`~+=-",
    "newline": b"\n",
    "high": bytes(range(128, 256)),
}
FEATURES = [
    "words", "word_length", "word_spread", *KINDS, "distinct", "repeated", "top_word", "line_repeats", "bytes_per_line",
]


@dataclass
class Settings:
    #: About how many labelled rows of each class are learned from: the bound of the training sample.
    per_class: int = 10_000
    bins: int = 64
    pair_bins: int = 16
    pairs: int = 6
    rounds: int = 120
    pair_rounds: int = 60
    rate: float = 0.15
    ridge: float = 5.0


@dataclass
class AdditiveModel:
    """``edges`` of the bins of each feature and their ``tables``; ``pairs``: (i, j, edges, edges, table)."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]


def _per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])


def byte_counts(data: np.ndarray) -> np.ndarray:
    """How often each byte occurs; a long text goes part by part."""
    out = np.zeros(256)
    for at in range(0, len(data), 1 << 20):
        out += np.bincount(data[at : at + (1 << 20)], minlength=256)
    return out


def text_features(column: pa.Array) -> np.ndarray:
    """Rows x ``FEATURES``: counts, shares and repetition of each text. A text without words has zeros."""
    out = np.zeros((len(column), len(FEATURES)))
    for row, offsets, data in text_pieces(column, 1 << 20):
        size = np.maximum(np.diff(offsets), 1)
        starts, ends, first = word_spans(data, offsets)
        words = np.diff(first)
        some = np.maximum(words, 1)
        lengths = (ends - starts).astype(float)
        mean = _per_document(lengths, first) / some
        spread = np.sqrt(np.maximum(_per_document(lengths**2, first) / some - mean**2, 0))
        columns = [np.log1p(words), mean, spread]
        counts = np.stack([byte_counts(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        columns += [counts[:, list(kind)].sum(axis=1) / size for kind in KINDS.values()]
        hashes = span_hashes(data, starts, ends, lower=True)
        fives = grams(hashes, 5)
        breaks = np.flatnonzero(data == 10)
        line_starts = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < len(data)], breaks + 1]))
        line_starts = line_starts[line_starts < len(data)]
        line_ends = np.append(line_starts[1:], len(data))
        lines = span_hashes(data, line_starts, line_ends)
        by_line = np.searchsorted(line_starts, offsets)
        extra = np.zeros((len(words), 5))
        for d in range(len(words)):
            own = hashes[first[d] : first[d + 1]]
            if len(own):
                _, times = np.unique(own, return_counts=True)
                extra[d, 0], extra[d, 2] = len(times) / len(own), times.max() / len(own)
                runs = fives[first[d] : max(first[d], first[d + 1] - 4)]
                extra[d, 1] = 1 - len(np.unique(runs)) / len(runs) if len(runs) else 0
                own_lines = lines[by_line[d] : by_line[d + 1]]
                n = max(len(own_lines), 1)
                extra[d, 3] = 1 - len(np.unique(own_lines)) / n
                extra[d, 4] = np.log1p(size[d] / n)
        out[row : row + len(words)] = np.column_stack([*columns, extra])
    return out


def featured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``features`` (doubles) of each row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = list(text_features(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "features"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, features array<double>")


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gains(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Gain of cutting a histogram after each bin but the last, and that of not cutting."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    total_g, total_h = g.sum(), h.sum()
    whole = total_g**2 / (total_h + ridge)
    return left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge), whole


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values per bin of a tree with two levels of cuts, grown on the histograms of slope and curvature."""
    bounds = [0, len(g)]
    for _ in range(2):
        more = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                gains, whole = _gains(g[a:b], h[a:b], ridge)
                if gains.max() > whole + 1e-9:
                    more.append(a + 1 + int(gains.argmax()))
        bounds = sorted(bounds + more)
    out = np.zeros(len(g))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Leaf values per cell of a tree that cuts rows, then columns on each side; and its gain over no cut."""
    best, at = -np.inf, None
    for cut in range(1, g.shape[0]):
        total, cuts = 0.0, []
        for half in (slice(0, cut), slice(cut, None)):
            gains, whole = _gains(g[half].sum(axis=0), h[half].sum(axis=0), ridge)
            k = int(gains.argmax()) + 1 if len(gains) and gains.max() > whole else 0
            total += gains[k - 1] if k else whole
            cuts.append((half, k))
        if total > best:
            best, at = total, cuts
    out = np.zeros(g.shape)
    for half, k in at or [(slice(None), 0)]:
        for side in (slice(0, k), slice(k, None)) if k else (slice(None),):
            out[half, side] = g[half, side].sum() / (h[half, side].sum() + ridge)
    return out, best - g.sum() ** 2 / (h.sum() + ridge)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, settings: Settings = Settings()) -> AdditiveModel:
    """Boost one feature after another, round after round, then the pairs whose trees gain most on what is left.

    Without rows of both classes, every row gets the smoothed share of label 1.
    """
    share = (weight[y == 1].sum() + 1) / (weight.sum() + 2) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    edges = [_edges(c, settings.bins) for c in x.T] if len(x) else [np.zeros(0)] * len(FEATURES)
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not ((y == 1).any() and (y == 0).any()):
        return AdditiveModel(bias, edges, tables, [])
    weight = weight * len(y) / weight.sum()
    bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]
    z = np.full(len(y), bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(settings.rounds):
        for b, table in zip(bins, tables, strict=True):
            if len(table) > 1:
                g, h = slopes()
                step = settings.rate * shallow_tree(
                    np.bincount(b, g, len(table)), np.bincount(b, h, len(table)), settings.ridge
                )
                table += step
                z += step[b]
    coarse = [_edges(c, settings.pair_bins) for c in x.T]
    cells = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T, strict=True)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = cells[i] * shape[1] + cells[j]
        g, h = slopes()
        return at, *(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    usable = [i for i in range(x.shape[1]) if len(coarse[i])]
    gains = {(i, j): pair_tree(*grid(i, j)[1:], settings.ridge)[1] for i, j in combinations(usable, 2)}
    chosen = sorted(gains, key=gains.get, reverse=True)[: settings.pairs]
    pair_tables = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(settings.pair_rounds):
        for i, j in chosen:
            at, g, h = grid(i, j)
            step = settings.rate * pair_tree(g, h, settings.ridge)[0]
            pair_tables[i, j] += step
            z += step.reshape(-1)[at]
    pairs = [(i, j, coarse[i], coarse[j], pair_tables[i, j]) for i, j in chosen]
    return AdditiveModel(bias, edges, tables, pairs)


def predict(model: AdditiveModel, x: np.ndarray) -> np.ndarray:
    """Probabilities: for whole columns, find the bins and add up what the tables hold for them."""
    z = np.full(len(x), model.bias)
    for column, edges, table in zip(x.T, model.edges, model.tables, strict=True):
        z += table[np.searchsorted(edges, column, "right")]
    for i, j, first, second, table in model.pairs:
        z += table[np.searchsorted(first, x[:, i], "right"), np.searchsorted(second, x[:, j], "right")]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(features: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings()) -> AdditiveModel:
    """Learn from a bounded sample of the labelled rows that are not held out (``settings.per_class``)."""
    known = trainable(labels.select("doc_id", F.col(label).cast("int").alias("label")).dropDuplicates(["doc_id"]))
    chosen = sample(known, "label", settings.per_class)
    data = features.join(F.broadcast(chosen), "doc_id").select("features", "label", "weight").toPandas()
    x = np.stack(data["features"].to_list()) if len(data) else np.zeros((0, len(FEATURES)))
    return train(x, data["label"].to_numpy(dtype=np.int64), data["weight"].to_numpy(dtype=np.float64), settings)


def score(features: DataFrame, model: AdditiveModel, threshold: float = 0.7) -> DataFrame:
    """One row per row: ``doc_id``, ``held_out``, ``score``, ``predicted`` (1 from ``threshold`` on)."""
    shared = features.sparkSession.sparkContext.broadcast(model)
    kind = dict(features.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("features").flatten().to_numpy(zero_copy_only=False)
            x = values.reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(predict(shared.value, x))], names=["doc_id", "score"]
            )

    out = features.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, settings: Settings = Settings()
) -> DataFrame:
    """Learn from ``labels`` (doc_id, ``label``) and score each row of ``docs``; see ``fit`` and ``score``.

    Only the text is read; null and empty texts score like a text of zeros. Repeated rows each get a row.
    """
    table, _ = store(featured(docs), "features")
    return score(table, fit(table, labels, label, settings), threshold)
