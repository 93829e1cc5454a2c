import random

import numpy as np
import xxhash
from tidemark.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp int"


def slow_fingerprint(text):
    words = []
    for c in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
        if c:
            words.append("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in c))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_classes(pairs):
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(pairs))]


def corpus():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)] + ["É", "ÉTÉ", "straße", "Ünder"]
    texts = [None, "", "  \n\t", "One", "one two THREE", "one two three four"]
    for _ in range(40):
        t = [rng.choice(words) for _ in range(rng.choice([5, 40, 400]))]
        texts.append(" ".join(t))
        for _ in range(rng.choice([0, 0, 1, 4])):
            u = list(t)
            u[rng.randrange(len(u))] = rng.choice(words)
            texts.append("\n".join([" ".join(u[:7]), " ".join(u[7:])]))
    texts += [texts[10]] * 5 + ["a " * 70_000]
    return [(i if i != 12 else None, t) for i, t in enumerate(texts)]


def test_fingerprint_is_the_definition():
    for _, t in corpus():
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "en", "s", 1, 9) for d, t in rows], DOCS).repartition(5)
    got = simhash.near_duplicates(df).collect()
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    want = sorted((str(d), f"{f:016x}", str(c)) for (d, f), c in zip(fps, slow_classes(fps)))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 1 and sorted(i for i in ids if i is not None) == sorted({int(c) for _, _, c in want if c != "None"})
    assert simhash.keep_first(df.union(df)).count() == len(ids)  # rows without an id take part


def test_search_is_exact_in_dense_and_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 50)
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    near = {centre}
    while len(near) < 300:  # a group of near copies: most pairs are more than 4 bits apart
        x = centre
        for b in rng.choice(64, 4, replace=False):
            x ^= 1 << int(b)
        near.add(x)
    fps = sorted(near | {int(v) for v in rng.integers(0, 1 << 62, 200)})
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = slow_classes(list(enumerate(fps)))
    n, both = simhash.bit_counts(df)
    assert n == len(fps) and both[0, 0] == sum(v & 1 for v in fps)
    equal = [simhash.Part(b, 0) for b in simhash.group_bits(n, both, 5)]
    mixed = [simhash.Part(b, t) for b, t in zip(simhash.group_bits(n, both, 3), (2, 0, 0))]
    for parts in (simhash.plan(n, both), equal, mixed):
        assert sum(p.threshold + 1 for p in parts) == 5
        root = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, parts)).collect()}
        groups = {}
        for i, v in enumerate(signed):
            groups.setdefault(root.get(v, v), []).append(i)
        assert sorted(map(tuple, groups.values())) == sorted(tuple(i for i, c in enumerate(want) if c == k) for k in set(want))


def test_plan_has_fewer_candidates_for_larger_corpora():
    both = np.full((64, 64), 0.25)
    np.fill_diagonal(both, 0.5)
    few, many = (simhash.plan(n, both * n) for n in (1_000, 10**10))
    assert len(few) > len(many)


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_first(df).count() == 0
