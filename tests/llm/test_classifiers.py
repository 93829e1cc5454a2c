import random
import zlib

import numpy as np
import pytest
from tidemark.llm import quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=400):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            t.insert(rng.randrange(len(t)), "blorgh")
            t.insert(rng.randrange(len(t)), "zwackig")
        if not good:
            t = [w.upper() + "!!" for w in t[:10]] * 8
        rows.append((i, " ".join(t), "en", "s", 1, 0.5))
        labels.append((i, int(good), int(toxic and good), "clash"))
    return rows, labels


@pytest.mark.parametrize(("module", "column", "parts", "out", "cut"), [(quality, 1, 4, 2, 0.7), (toxicity, 2, 5, 0, 0.5)])
def test_held_out_accuracy_and_columns(spark, module, column, parts, out, cut):
    rows, labels = corpus()
    extra = [(None, "x", None, None, None, None), (9001, None, None, None, None, None), (9002, "", "en", "s", 0, 0.0), (9003, "blorgh " * 30_000, "en", "s", 0, 0.0), (9003, "twice", "en", "s", 0, 0.0)]
    docs = spark.createDataFrame(rows + extra, DOCS).repartition(3)
    got = module.classify(docs, spark.createDataFrame(labels + [(3, None, None, "x"), (None, 1, 1, "x")], LABELS)).collect()
    assert got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"} and len(got) == len(rows) + len(extra)
    truth = {r[0]: r[column] for r in labels}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % parts == out) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_scores_ignore_held_out_labels(spark):
    rows, labels = corpus(120)
    docs = spark.createDataFrame(rows, DOCS)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, x) for i, q, t, x in labels]
    for m in (quality, toxicity):
        a, b = (sorted(map(tuple, m.classify(docs, spark.createDataFrame(x, LABELS)).collect())) for x in (labels, flipped))
        assert a == b


def test_empty_and_unlabelled(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "en", "s", 3, 0.0)], DOCS)
    labels = spark.createDataFrame([], LABELS)
    for m in (quality, toxicity):
        assert m.classify(none, labels).count() == 0
        assert m.classify(some, labels).collect()[0]["score"] == 0.5
    kept = quality.keep_good(some, labels)
    assert kept.columns == some.columns and kept.count() == 0


def test_trees_walk_like_a_loop():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(quality.FEATURES)))
    f = quality.fit(x, (x[:, 0] + x[:, 3] > 0).astype(float))

    def walk(row):
        total = f.base
        for feat, thr, leaf in zip(f.feature, f.threshold, f.leaf):
            i = 0
            while i < 2**quality.DEPTH - 1:
                i = 2 * i + 1 + (row[feat[i]] > thr[i])
            total += leaf[i - 2**quality.DEPTH + 1]
        return total

    assert np.allclose(f.margin(x), [walk(r) for r in x])
    assert ((f.score(x) > 0.5) == (x[:, 0] + x[:, 3] > 0)).mean() > 0.95


def test_ngram_buckets_do_not_depend_on_chunks(monkeypatch):
    text = "Größe und Wörter " * 40
    whole = toxicity.buckets(text)
    monkeypatch.setattr(toxicity, "CHUNK", 37)
    assert (toxicity.buckets(text) == whole).all() and len(toxicity.buckets(None)) == 0


def test_regression_equals_a_dense_one():
    rng = np.random.default_rng(3)
    size, n = 40, 90
    x = rng.random((n, size)) < 0.2
    y = (x[:, 3] | x[:, 7]).astype(float)
    r = np.where(rng.random(size) < 0.7, rng.normal(size=size), 0.0)
    got = toxicity.regress([np.flatnonzero(row & (r != 0)) for row in x], y, r)
    # the same steps on the whole matrix, one weight at a time
    w, seen, bias, bias_seen = [0.0] * size, [1e-6] * size, 0.0, 1e-6
    order = np.random.default_rng(11)
    for _ in range(toxicity.EPOCHS):
        for rows in np.array_split(order.permutation(n), max(1, n // toxicity.BATCH)):
            err = {}
            for i in rows:
                z = bias + sum(w[j] * r[j] for j in range(size) if x[i, j])
                share = 0.5 / (y.sum() if y[i] else n - y.sum()) * n
                err[i] = (1 / (1 + np.exp(-z)) - y[i]) * share / len(rows)
            for j in range(size):
                if r[j] and any(x[i, j] for i in rows):
                    g = sum(err[i] * r[j] for i in rows if x[i, j]) + toxicity.L2 * w[j]
                    seen[j] += g * g
                    w[j] -= toxicity.STEP * g / np.sqrt(seen[j])
            total = sum(err.values())
            bias_seen += total**2
            bias -= toxicity.STEP * total / np.sqrt(bias_seen)
    assert np.allclose(got.weight, np.array(w) * r, atol=1e-6) and np.isclose(got.bias, bias)


def test_counts_in_tasks_equal_brute_force(spark, monkeypatch):
    rows, labels = corpus(150)
    docs, known = spark.createDataFrame(rows + rows[:5], DOCS).repartition(4), spark.createDataFrame(labels, LABELS)
    seen = {}
    monkeypatch.setattr(toxicity, "log_ratios", lambda counts, n: seen.update(counts=counts, n=n) or np.where(counts.sum(0) > 0, 1.0, 0.0))
    toxicity.train(docs, known)
    want = np.zeros((2, 1 << toxicity.BITS))
    n = [0, 0]
    for r, (_, _, t, _) in zip(rows, labels):
        if zlib.crc32(str(r[0]).encode()) % 5:
            n[t] += 1
            want[t][toxicity.buckets(r[1])] += 1
    want[:, want.sum(0) < toxicity.MIN_DOCS] = 0
    assert seen["n"].tolist() == n and np.array_equal(seen["counts"], want)


def test_first_split_equals_a_slow_search():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (120, 4)).astype(float)
    y = ((x[:, 2] > 4) ^ (rng.random(120) < 0.1)).astype(float)
    forest = quality.fit(x, y)
    p = y.mean()
    g, h = p - y, np.full(120, p * (1 - p))
    best = (0.0, None)
    for j in range(4):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])):
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= quality.MIN_ROWS:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + quality.L2) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + quality.L2)
                if gain > best[0] + 1e-9:
                    best = (gain, (j, cut))
    assert (int(forest.feature[0][0]), float(forest.threshold[0][0])) == best[1]
