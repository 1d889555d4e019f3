"""A quality classifier: histogram gradient-boosted trees over statistics of the text alone.

The trees are complete, of one depth, and lie in three arrays (feature, threshold, leaf value), so that numpy walks
all rows and trees together, one level at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable

#: Labelled rows that the model is fitted on, at most: those of the smallest hash of doc_id.
SAMPLE_ROWS = 20_000
HELD_OUT_REMAINDER = 2
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 80, 4, 64, 0.15, 1.0, 4.0

CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#*$%&", b"|", b"<>{}[]()=/\\_+", b"\n", b" \t\r\x0b\x0c", bytes(range(128, 256))]
N_FEATURES = len(CLASSES) + 13


def features(text: str | None) -> list[float]:
    """Statistics of a text: shares of byte classes, words, repetition, lines and sentences."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(len(raw), 1)
    shares = [float(counts[list(c)].sum()) / size for c in CLASSES]
    words = raw.split()
    n = len(words)
    if not n:
        return [*shares, *[0.0] * 13]
    lengths = np.fromiter(map(len, words), np.int64, n)
    tally = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stops = int(counts[[46, 33, 63]].sum())
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 0
    return [
        *shares,
        float(np.log1p(n)),
        float(lengths.mean()),
        float(lengths.std()),
        float(np.log1p(lengths.max())),
        len(tally) / n,
        max(tally.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        pairs / max(n - 1, 1),
        sum(x.isupper() for x in words) / n,
        sum(x[-1:].isalnum() or x[-1] > 127 for x in words) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        n / (1 + stops),
    ]


@dataclass
class Trees:
    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        if not self.feature.size:
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        at = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        inner = self.feature.shape[1]
        while (at[0, 0] if len(x) else inner) < inner:
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return 1 / (1 + np.exp(-(self.prior + self.value[tree, at - inner].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting on the logistic loss; without both labels, a constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(share / (1 - share)))
    inner = 2**DEPTH - 1
    if len(y) < 2 or y.min() == y.max():
        return Trees(prior, np.empty((0, inner), np.int64), np.empty((0, inner)), np.empty((0, inner + 1)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    bins = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    n_features, flat = x.shape[1], bins + np.arange(x.shape[1]) * BINS
    raw = np.full(len(y), prior)
    feature, threshold, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            nodes = 2**depth
            index = (node[:, None] * n_features * BINS + flat).ravel()
            shape = (nodes, n_features, BINS)
            g = np.bincount(index, np.repeat(gradient, n_features), np.prod(shape)).reshape(shape).cumsum(axis=2)
            h = np.bincount(index, np.repeat(weight, n_features), np.prod(shape)).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain = np.where((h >= LEAST_WEIGHT) & (all_h - h >= LEAST_WEIGHT), gain, 0).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            for k in np.flatnonzero(gain.max(axis=1) > 1e-9):
                f, b = divmod(int(best[k]), BINS)
                if b < len(edges[f]):
                    feature[t, nodes - 1 + k], threshold[t, nodes - 1 + k] = f, edges[f][b]
            at = nodes - 1 + node
            node = 2 * node + (x[np.arange(len(y)), feature[t, at]] > threshold[t, at])
        g, h = np.bincount(node, gradient, inner + 1), np.bincount(node, weight, inner + 1)
        value[t] = -RATE * g / (h + RIDGE)
        raw += value[t][node]
    return Trees(prior, feature, threshold, value)


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["rank"], batch["quality"], pa.array([features(x.as_py()) for x in batch["text"]], pa.list_(pa.float64()))], ["rank", "quality", "x"])


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fits on at most sample_rows labelled documents outside the held-out quarter, whichever order they come in.

    Labels that are null or not 0 or 1, a null doc_id, and labels without a document don't count. Of several labels of
    one id the smallest counts; repeated documents of one id count each, and null texts as empty ones. Other columns are
    not read. Without rows, or with labels of one kind only, the model is a constant.
    """
    importable(documents.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 4 != HELD_OUT_REMAINDER))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality")).withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(sample_rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("rank", "quality", "text")
    found = rows.mapInArrow(feature_rows, "rank long, quality long, x array<double>").orderBy("rank", "x").limit(sample_rows).collect()
    return fit(np.array([r.x for r in found], float).reshape(-1, N_FEATURES), np.array([r.quality for r in found], float))


def scored(df: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """df with held_out, score and predicted.

    Null and empty texts get the score of a text without words. A null doc_id is not held out. Repeated rows get the
    same score. Columns of df with these names are replaced. An empty table stays empty.
    """
    importable(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([features(t.as_py()) for t in texts], float).reshape(-1, N_FEATURES)
            yield pa.array(np.concatenate([shared.value.score(x[i : i + 2000]) for i in range(0, len(x), 2000)] or [np.empty(0)]))

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT_REMAINDER, F.lit(False))
    out = df.withColumns({"held_out": held_out, "score": F.arrow_udf(score, "double")(F.col(text))})
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
