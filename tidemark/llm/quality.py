"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text are computed once in the scoring tasks. Trees are grown on binned statistics (one gradient and
one hessian histogram for each feature and node) and kept as flat arrays in heap order, so that a batch of documents
walks all trees with a few numpy gathers for each level.

Defined results: a null text counts as the empty text and gets a score; repeated rows give repeated rows; a null doc_id
is scored with held_out false; a table with no usable labels, or with labels of one class, gives that class's rate (0.5
without any) as every score; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled

#: Bound on the labelled rows that fit the trees.
TRAIN_ROWS = 12_000
HELD_OUT = (4, 2)
ACCEPT = 0.7
TREES, DEPTH, BINS, RATE, L2, MIN_ROWS = 60, 4, 64, 0.2, 1.0, 20

_CLASS = np.zeros(256, np.int64)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 blank, 5 newline, 6 sentence marks, 7 non-ASCII
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 1, 2, 3
_CLASS[[32, 9]], _CLASS[[10, 13]], _CLASS[[ord(c) for c in ".,;:?!"]], _CLASS[128:] = 4, 5, 6, 7
_WORD = re.compile(r"[^\W\d_]+")
FEATURES = (
    "chars lower upper digit blank newline mark other wide words mean_word long_words short_words distinct top_word adjacent "
    "lines distinct_lines top_line bare_words caps_words pure_words distinct_halves common"
).split()


def statistics(text: str | None) -> list[float]:
    """The features of one text, in the order of FEATURES; every text has all of them."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    by_class = np.bincount(_CLASS[raw], minlength=8) if len(raw) else np.zeros(8)
    n = max(1, len(raw))
    words = text.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    in_lines: dict[str, int] = {}
    for x in lines:
        in_lines[x] = in_lines.get(x, 0) + 1
    alphabetic = sum(map(str.isalpha, words))
    half = words[: len(words) // 2]
    return [
        np.log1p(len(raw)), *(by_class[[1, 2, 3, 4, 5, 6, 0, 7]] / n), np.log1p(len(words)), lengths.mean(), (lengths > 14).sum() / k, (lengths < 3).sum() / k,
        len(counts) / k, max(counts.values(), default=0) / k, sum(a == b for a, b in zip(words, words[1:])) / k,
        np.log1p(len(lines)), len(in_lines) / max(1, len(lines)), max((c * len(x) for x, c in in_lines.items()), default=0) / n,
        sum(not any(map(str.isalnum, w)) for w in counts) / max(1, len(counts)), sum(map(str.isupper, counts)) / max(1, len(counts)), alphabetic / k,
        len(set(half)) / max(1, len(half)), sum(c for c in counts.values() if c > 2) / k,
    ]


@dataclass
class Forest:
    """All trees as arrays of shape (trees, nodes): node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - (2**DEPTH - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Newton boosting on the logistic loss. Ties between splits go to the lower feature, then the lower bin."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    rate = float(y.mean()) if len(y) else 0.5
    base = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))) if len(y) else 0.0
    if len(y) == 0 or rate in (0.0, 1.0):
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin b: at most edges[b]
    flat = binned + np.arange(width) * BINS
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        cut = np.full(inner, BINS)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first = 2**level - 1
            key = ((at - first)[:, None] * width * BINS + flat).ravel()
            shape = (2**level, width, BINS)
            size = 2**level * width * BINS
            gs, hs = (np.bincount(key, np.repeat(v, width), size).reshape(shape).cumsum(2) for v in (g, h))
            ns = np.bincount(key, minlength=size).reshape(shape).cumsum(2)
            gt, ht, nt = gs[:, :, -1:], hs[:, :, -1:], ns[:, :, -1:]
            gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
            gain[(ns < MIN_ROWS) | (nt - ns < MIN_ROWS)] = -1
            best = gain.reshape(2**level, -1).argmax(1)
            for k in range(2**level):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    f[first + k], t[first + k], cut[first + k] = j, edges[j][b], b
            at = 2 * at + 1 + (binned[np.arange(n), f[at]] > cut[at])
        leaf = at - inner
        v = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        margin += v[leaf]
        features.append(f)
        thresholds.append(t)
        values.append(v)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """The forest of a bounded sample. Texts become statistics in the tasks, so the driver gets some 200 bytes for each."""
    known = labelled(docs, labels, "quality", *HELD_OUT, rows)

    def run(batches):
        for b in batches:
            x = [[float(v) for v in statistics(t)] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    kind = known.schema["doc_id"].dataType.simpleString()
    got = sorted(known.mapInArrow(run, f"doc_id {kind}, y int, x array<double>").collect(), key=lambda r: (r["doc_id"], r["x"]))
    return fit(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([float(r["y"] > 0) for r in got]))


def score_texts(df: DataFrame, forest: Forest, key: str = "doc_id") -> DataFrame:
    """(key, score) for every row of df."""
    model = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pa.record_batch([b.column(0), pa.array(model.value.score(x))], names=[key, "score"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "text").mapInArrow(run, f"{key} {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score_texts(docs, train(docs, labels, rows))
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text scores at least ACCEPT."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield b.filter(pa.array(model.value.score(x) >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)
