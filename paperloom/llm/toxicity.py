"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are hashed n-grams of lower-cased text, present or absent in a document. Their log-count ratios
come from smoothed document counts of both classes; a logistic regression is trained on the scaled
features that tell the classes apart best.

Fit: counts and regression use the labelled documents, at most `fit_rows` of them (those whose ids have
the smallest hashes). Scoring covers every document and its whole text in one narrow pass.

Defined results: null text counts as empty and is scored by the bias; null labels are left out of the fit;
without both labels in the fit every score is the share of positive labels (0.5 without labels); repeated
rows give repeated results; a text of any length is counted and scored whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_io import id_and_text, map_arrow, runs_of_chars, struct

ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 20
#: Characters between two texts of a slice, so that no n-gram meets two texts.
GAP = "\0" * (ORDERS[-1] - 1)


@dataclass
class Classifier:
    """slots: the feature of each bucket, or -1; weights: of each feature, already scaled by its ratio."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float


def spread(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each behind a gap, and where each begins (one more at the end)."""
    low = [GAP + t.lower() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in low])])
    return np.frombuffer(("".join(low) + GAP).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def buckets(codes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each order: the bucket of the n-gram that begins at each of the first n places."""
    h = np.zeros(n, np.uint32)
    done = 0
    for order in ORDERS:
        for k in range(done, order):
            h = h * np.uint32(0x9E3779B1) + codes[k : k + n]
        done = order
        yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)


def present(texts: list[str], slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) once for each selected feature that a text has."""
    codes, starts = spread(texts)
    n, width = int(starts[-1]), int(slots.max(initial=0)) + 1
    keys = []
    for b in buckets(codes, n):
        own = slots[b]
        at = np.nonzero(own >= 0)[0]
        keys.append((np.searchsorted(starts, at, side="right") - 1) * width + own[at])
    key = np.unique(np.concatenate(keys))
    return key // width, key % width


def count_features(texts: list[str], labels: np.ndarray, counts: np.ndarray) -> None:
    """Adds to counts[label, bucket] the texts of that label that have the bucket."""
    for text, label in zip(texts, labels):
        codes, starts = spread([text])
        seen = np.zeros(counts.shape[1], bool)
        for b in buckets(codes, int(starts[-1])):
            seen[b] = True
        counts[label] += seen


def logistic(doc: np.ndarray, feature: np.ndarray, scale: np.ndarray, labels: np.ndarray, rounds: int = 200, ridge: float = 3e-4, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights of the scaled features, and the bias, by Adam on the whole set."""
    n, width = len(labels), len(scale)
    value = scale[feature]
    share = labels.mean()
    weight = np.where(labels == 1, np.sqrt((1 - share) / share), 1.0)  # half way, in logarithms, to equal classes
    w, bias = np.zeros(width + 1), np.log(share / (1 - share))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(doc, w[feature] * value, minlength=n) + bias + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight / n
        g = np.append(np.bincount(feature, error[doc] * value, minlength=width) + ridge * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(bias + w[-1])


def select_features(counts: np.ndarray, totals: np.ndarray, features: int, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with the largest chi-square, and their log-count ratios. counts: (2, n) documents by label."""
    seen = counts.sum(0)
    expected = seen[None] * (totals / totals.sum())[:, None]
    rest = totals.sum() - seen
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num(((counts - expected) ** 2 / expected).sum(0) * totals.sum() / rest, posinf=0, nan=0)
    chi[seen < least] = 0
    best = np.argsort(-chi, kind="stable")[:features]
    best = best[chi[best] > 0]
    ratio = np.log((counts[1, best] + 1) / (totals[1] + 2)) - np.log((counts[0, best] + 1) / (totals[0] + 2))
    return best, ratio


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 20_000, features: int = 4096) -> Classifier:
    """Fits the classifier on the documents that labels marks 0 or 1, at most fit_rows of them."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"))
    marked = marked.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id")).limit(fit_rows)
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(marked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_label")

    def count(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        totals = np.zeros(2, np.int64)
        for batch in batches:
            own = batch.column(2).to_numpy()
            totals += np.bincount(own, minlength=2)
            count_features(batch.column(1).to_pylist(), own, counts)
        at = np.nonzero(counts.any(0))[0]
        yield {"bucket": np.append(at, -1).astype(np.int32), "zero": np.append(counts[0, at], totals[0]).astype(np.int64), "one": np.append(counts[1, at], totals[1]).astype(np.int64)}

    summed = map_arrow(texts, count, struct("bucket int, zero long, one long")).groupBy("bucket").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"))
    table = summed.where("bucket < 0 or zero + one >= 5").toPandas().sort_values("bucket")  # one row for each bucket at most
    found = table[table.bucket >= 0]
    totals = table[table.bucket < 0][["zero", "one"]].sum().to_numpy(np.float64)
    none = Classifier(np.full(1 << BUCKET_BITS, -1, np.int16), np.zeros(1, np.float32), 0.0)
    if not totals.all():
        none.bias = 0.0 if not totals.any() else (30.0 if totals[1] else -30.0)
        return none
    best, ratio = select_features(found[["zero", "one"]].to_numpy(np.float64).T, totals, features)
    slots = none.slots.copy()
    slots[found.bucket.to_numpy()[best]] = np.arange(len(best), dtype=np.int16)
    sent = docs.sparkSession.sparkContext.broadcast(slots)

    def featurise(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            own = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            for ids, slice_ in runs_of_chars(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc, feature = present(slice_, sent.value)
                ends = np.searchsorted(doc, np.arange(len(ids) + 1))
                blobs = feature.astype("<u2")
                yield {"label": [own[i] for i in ids], "features": [blobs[a:b].tobytes() for a, b in zip(ends, ends[1:])]}

    rows = map_arrow(texts, featurise, struct("label int, features binary")).toPandas()  # at most fit_rows rows of 2 * features bytes
    parts = [np.frombuffer(x, "<u2") for x in rows.features]
    doc = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    weights, bias = logistic(doc, np.concatenate(parts).astype(np.int64), ratio, rows.label.to_numpy(np.float64))
    return Classifier(slots, (weights * ratio).astype(np.float32), bias)


def score(df: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row; score is the probability of label 1."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        own = sent.value
        for batch in batches:
            for ids, texts in runs_of_chars(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc, feature = present(texts, own.slots)
                z = np.bincount(doc, own.weights[feature], minlength=len(ids)) + own.bias
                yield {"doc_id": ids, "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}

    return map_arrow(id_and_text(df, id_col, text_col), run, struct("doc_id long, score double"))
