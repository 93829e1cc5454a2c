"""Toxicity: a character n-gram linear classifier over features scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed character n-grams (2 to 5 code points of the lower-cased text). Feature j has
the value r_j, the log ratio of its smoothed document rates among toxic and other labelled texts; a logistic regression
over those values gives the weights, and weight times ratio is folded into one array for scoring.

Defined results: a null text counts as the empty text and gets the score of the intercept; repeated rows give repeated
rows, and an id is learned from once; a null doc_id is scored with held_out false; without labels of both classes every score is that class's rate (0.5
without any); columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled

#: Bound on the labelled rows that fit the classifier.
TRAIN_ROWS = 8_000
HELD_OUT = (5, 0)
BITS, ORDERS, CHUNK = 20, (2, 3, 4, 5), 1 << 20
SMOOTH, MIN_DOCS, MIN_RATIO = 1.0, 4, 1.0
EPOCHS, BATCH, STEP, L2 = 8, 64, 0.05, 1e-4


def buckets(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """The distinct n-gram buckets of a whole text, in order; only those that are wanted, if given.

    Long texts are hashed in chunks that overlap by the longest n-gram less one, so memory stays bounded.
    """
    text, found = (text or "").lower(), []
    for start in range(0, max(1, len(text)), CHUNK):
        cp = np.frombuffer(text[start : start + CHUNK + max(ORDERS) - 1].encode("utf-32-le", "replace"), np.uint32)
        h = cp * np.uint32(2654435761)
        for n in range(2, max(ORDERS) + 1):
            if len(cp) < n:
                break
            h = (h[:-1] ^ np.uint32(n)) * np.uint32(1597334677) + cp[n - 1 :] * np.uint32(3266489917)
            if n in ORDERS:
                idx = ((h ^ (h >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(32 - BITS)
                found.append(np.unique(idx if wanted is None else idx[wanted[idx]]))
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    weight: np.ndarray  # of each bucket: regression weight times log-count ratio
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        wanted = self.weight != 0
        z = np.array([self.bias + float(self.weight[buckets(t, wanted)].sum()) for t in texts])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_ratios(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """r of each bucket from (2, buckets) document counts and the number of documents by class; 0 for buckets left out."""
    r = np.log((counts[1] + SMOOTH) / (n[1] + 2 * SMOOTH)) - np.log((counts[0] + SMOOTH) / (n[0] + 2 * SMOOTH))
    r[(counts.sum(0) < MIN_DOCS) | (np.abs(r) < MIN_RATIO)] = 0
    return r


def regress(docs: list[np.ndarray], y: np.ndarray, r: np.ndarray) -> Model:
    """Logistic regression over the values r of each document's buckets, by Adagrad, classes weighted equally."""
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)
    w, seen, bias, bias_seen = np.zeros(len(r)), np.full(len(r), 1e-6), 0.0, 1e-6
    weight, order = np.where(y == 1, 0.5 / n[1], 0.5 / n[0]) * len(y), np.random.default_rng(11)
    for _ in range(EPOCHS):
        for rows in np.array_split(order.permutation(len(y)), max(1, len(y) // BATCH)):
            idx = np.concatenate([docs[i] for i in rows])
            lengths = np.array([len(docs[i]) for i in rows])
            owner = np.repeat(np.arange(len(rows)), lengths)
            z = np.bincount(owner, w[idx] * r[idx], len(rows)) + bias
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            u, inverse = np.unique(idx, return_inverse=True)
            g = np.bincount(inverse, err[owner] * r[idx], len(u)) + L2 * w[u]
            seen[u] += g * g
            w[u] -= STEP * g / np.sqrt(seen[u])
            bias_seen += err.sum() ** 2
            bias -= STEP * err.sum() / np.sqrt(bias_seen)
    return Model((w * r).astype(np.float32), float(bias))


def constant(y: np.ndarray) -> Model:
    """Every score is the rate of the labels (0.5 without any)."""
    rate = float(y.mean()) if len(y) else 0.5
    return Model(np.zeros(1 << BITS, np.float32), float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of a bounded sample. Tasks count the documents of each bucket and class; the driver gets the counts of the
    buckets that are kept, 2 ** BITS at most, and then, of each document, the kept buckets alone."""
    sample = labelled(docs, labels, "toxic", *HELD_OUT, rows)
    size = 1 << BITS

    def count(batches):
        counts = np.zeros((2, size), np.int32)
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[int(y > 0)][buckets(t)] += 1
        at = np.flatnonzero(counts.any(0))
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["bucket", "c0", "c1"])

    per_class = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("y") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n = np.array([per_class.get(False, 0), per_class.get(True, 0)], float)
    if not n.all():
        return constant(np.repeat([0.0, 1.0], n.astype(int)))
    found = sample.select("text", "y").mapInArrow(count, "bucket int, c0 int, c1 int").groupBy("bucket").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    got = found.where(F.col("c0") + F.col("c1") >= MIN_DOCS).toArrow()
    counts = np.zeros((2, size))
    for k, name in enumerate(("c0", "c1")):
        counts[k][got["bucket"].to_numpy()] = got[name].to_numpy()
    r = log_ratios(counts, n)
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(r != 0))

    def kept(batches):
        mask = np.unpackbits(wanted.value).astype(bool)
        for b in batches:
            own = [buckets(t, mask).astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "y", "own"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    table = sample.mapInArrow(kept, f"doc_id {kind}, y int, own array<int>").toArrow().sort_by("doc_id")
    return regress([np.asarray(x, np.int64) for x in table["own"].to_pylist()], (table["y"].to_numpy() > 0).astype(float), r)


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(model.value.score(b.column(1).to_pylist()))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
