import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tidemark.llm import bm25, decontam, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, rank int"


def corpus(n=260):
    rng = random.Random(6)
    words = ["w%d" % int(rng.paretovariate(0.7)) for _ in range(4000)] + ["größe", "42"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 200])))) for i in range(n)]
    rows += [(400 + i, rows[20][1]) for i in range(15)] + [(None, rows[20][1]), (600, None), (620, ""), (640, "w1 " * 20_000), (660, "only-here"), (20, "w2 w3 extra"), (20, "w2 w3 extra")]
    return [(i, t, "en", "s", 1, 7, 7) for i, t in rows]


def brute(rows, k, max_terms):
    docs = [(r[0], Counter(re.findall(r"[^\W_]+", (r[1] or "").lower()))) for r in rows]
    n, avgdl = len(docs), sum(d.total() for _, d in docs) / len(docs)
    df = Counter(t for _, d in docs for t in d)
    idf = {t: math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in df.items()}

    def impact(tf, dl):
        return tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * dl / avgdl))

    out = {}
    for q in sorted({i for i, _ in docs if i is not None and i % 20 == 0}):
        terms, dl = Counter(), 0
        for i, d in docs:
            if i == q:
                terms, dl = terms + d, max(dl, d.total())
        chosen = sorted(terms, key=lambda t: (-round(idf[t] * impact(terms[t], dl), 6), bm25.term_id(t)))[:max_terms]
        chosen.sort(key=bm25.term_id)
        scored = [(round(sum(idf[t] * impact(d[t], d.total()) for t in chosen if t in d), 6), i) for i, d in docs if any(t in d for t in chosen)]
        out[q] = sorted(scored, key=lambda x: (-x[0], math.inf if x[1] is None else x[1]))[:k]
    return out


@pytest.mark.parametrize(("max_terms", "shard"), [(32, 10**9), (6, 1500), (None, 3000)])
def test_search_equals_brute_force(spark, max_terms, shard, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK", 4)
    rows = corpus()
    got = {}
    for r in bm25.search(spark.createDataFrame(rows, DOCS).repartition(5), max_terms=max_terms, shard_postings=shard).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["doc_id"]))
    want = {q: v for q, v in brute(rows, bm25.TOP, max_terms).items() if v}
    assert got.keys() == want.keys()
    for q, v in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, len(v) + 1))
        assert np.allclose([s for _, s, _ in mine], [s for s, _ in v], atol=2e-6)
        assert [d for _, _, d in mine] == [d for _, d in v]


def test_skipped_blocks_are_not_touched():
    rng = np.random.default_rng(1)
    n = 20_000
    terms, tfs, sizes = [], [], []
    for d in range(n):  # term 0 in all documents, terms 1 and 2 in long runs of them, the others rare
        own = [0, *([1] if d // 500 % 4 == 0 else []), *([2] if d // 500 % 3 == 0 else []), *(3 + rng.choice(2000, 3, replace=False))]
        terms += own
        tfs += list(rng.geometric(0.3 if d % 700 else 0.02, len(own)))
        sizes.append(len(own))
    shard = bm25.Shard(np.arange(n), np.full(n, 5), np.array(terms), np.array(tfs, np.int32), np.array(sizes), 5.0)
    assert len(shard.most) == 3
    queries = [(np.array([0, 1, 2, 40]), np.array([0.05, 1.4, 1.1, 6.0])), (np.array([1, 90, 91]), np.array([1.4, 6.0, 6.0])), (np.array([0]), np.array([0.05]))]
    found = shard.search(queries, 10, [-np.inf] * 3, [0] * 3)
    owner, position = np.repeat(np.arange(n), sizes), {t: i for i, t in enumerate(shard.terms)}
    impact = np.array(tfs) * (bm25.K1 + 1) / (np.array(tfs) + bm25.K1 * (1 - bm25.B + bm25.B * 5 / 5.0))
    for (slots, idf), (rows, scores) in zip(queries, found):
        sums = np.zeros(n)
        for s, w in zip(slots, idf):
            at = np.flatnonzero(np.array(terms) == shard.terms[s])
            sums[owner[at]] += w * impact[at]
        want = sorted(((-round(v, 6), d) for d, v in enumerate(sums) if v > 0))[:10]
        assert [d for _, d in want] == shard.doc_ids[rows].tolist() and np.allclose(scores, [-v for v, _ in want], atol=2e-6)
    assert position[0] == 0 and shard.read < 0.8 * shard.blocks and shard.entered < 0.5 * 3 * shard.blocks and shard.scored < 200
    # the long lists of the other blocks could hold anything
    shard.dense[~shard.seen] = np.nan
    again = shard.search(queries, 10, [-np.inf] * 3, [0] * 3)
    assert all(np.array_equal(a, b) for x, y in zip(found, again) for a, b in zip(x, y))
    # a bound that is met by nothing: no block at all
    before = shard.read
    assert len(shard.search(queries[:1], 10, [1e9], [0])[0][0]) == 0 and shard.read == before


def test_like_documents_share_blocks_and_like_queries_a_batch():
    rng = np.random.default_rng(2)
    n, own = 4000, 25
    terms = [rng.choice(60, own, replace=False) + 100 * (d % 4) for d in range(n)]  # four vocabularies by turns
    ids = np.array([bm25.term_id(str(t)) for t in range(400)])
    tfs, sizes = rng.geometric(0.5, n * own).astype(np.int32), np.full(n, own)
    shard = bm25.Shard(np.arange(n), np.full(n, 40), ids[np.concatenate(terms)], tfs, sizes, 40.0)
    known, slots = shard.slots(np.concatenate([ids[np.concatenate(terms[:64])], [0, 2**60 - 1]]))
    assert known.tolist() == [True] * 64 * own + [False] * 2 and np.array_equal(shard.terms[slots], ids[np.concatenate(terms[:64])])
    slots = np.sort(slots.reshape(64, own))
    group = shard.groups(np.repeat(np.arange(64), own), slots.ravel(), 64)
    assert all(set(group[v::4]).isdisjoint(group[w::4]) for v in range(4) for w in range(v))
    impact = tfs * (bm25.K1 + 1) / (tfs + bm25.K1)
    sums = np.zeros((n, len(shard.terms)))
    sums[np.repeat(np.arange(n), own), np.searchsorted(shard.terms, ids[np.concatenate(terms)])] = impact
    for v in range(4):
        queries, before = [(s, np.linspace(0.5, 2, own)) for s in slots[v::4]], shard.read
        for (s, idf), (rows, scores) in zip(queries, shard.search(queries, 10, [-np.inf] * 16, [0] * 16)):
            want = sorted(zip(np.round(-(sums[:, s] @ idf), 6).tolist(), range(n)))[:10]
            assert [d for _, d in want] == shard.doc_ids[rows].tolist() and np.allclose(scores, [-x for x, _ in want], atol=2e-6)
        assert shard.read - before < 0.3 * shard.blocks


def test_words_are_runs_of_letters_and_digits():
    rng = random.Random(3)
    texts = ["".join(map(chr, range(128))), "".join(f"a{chr(c)}B_" for c in range(0x3000) if not 0xD800 <= c < 0xE000), "__init__ x_1 Ünder_score İ_ǅ ² ٣"]
    texts += ["".join(rng.choice("aB9_ .\n\x1c\x85éΣ") for _ in range(30)) for _ in range(300)]
    assert all(bm25.words(t) == re.findall(r"[^\W_]+", t.lower()) for t in texts)


def test_query_takes_all_terms(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in queries.op5_bm25(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == {q: [d for _, d in v] for q, v in brute(rows, bm25.TOP, None).items() if v}


def test_search_of_nothing(spark):
    assert bm25.search(spark.createDataFrame([], DOCS)).count() == 0


def leaks(spark):
    rng = random.Random(9)
    words = ["t%d" % i for i in range(700)] + ["Straße", "Été"]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, pick(n)) for i, n in enumerate([14, 20, 40, 60, 9, 12, 8, 0, 10, 5])] + [(None, pick(30))]
    docs = []
    for i in range(120):
        t = pick(rng.choice([0, 5, 60, 300]))
        if i % 3 == 0:
            own = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 2, len(own) // 3])):
                if own:
                    own[rng.randrange(len(own))] = "edited"
            cut = own[: rng.choice([len(own), len(own), max(0, len(own) - 6), 10])]
            t[len(t) // 2 : len(t) // 2] = cut
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(t).upper() if i % 2 else " ".join(t)))
    docs += [(None, " ".join(items[2][1])), (5, docs[3][1]), (3, docs[3][1]), (200, None), (201, " ".join(pick(20_000) + items[3][1]))]
    return [(d, t, "en", "s", 1, 1, 1) for d, t in docs], [(i, " ".join(t)) for i, t in items] + [(99, None)]


def brute_leaks(docs, items):
    """The overlap rule on every diagonal of every pair, without seeds."""
    out = []
    for d, t, *_ in docs:
        a = re.findall(r"[^\W_]+", (t or "").lower())
        for item, s in items:
            b = re.findall(r"[^\W_]+", (s or "").lower())
            best = None
            for diag in range(-len(b), len(a) + 1) if b else ():
                lo, hi = max(0, -diag), min(len(b), len(a) - diag)
                same = [a[i + diag] == b[i] for i in range(lo, hi)]
                span = min(decontam.SPAN, len(b))
                need = math.ceil(span * decontam.SHARE)
                if len(same) >= span and max(sum(same[i : i + span]) for i in range(len(same) - span + 1)) >= need:
                    best = max(best or (0, 0), (sum(same), -(lo + diag)))
            if best:
                out.append((str(d), str(item), best[0], -best[1]))
    return sorted(out)


@pytest.mark.parametrize("bound", [10**6, 250])
def test_leaks_equal_brute_force(spark, bound, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", bound)
    monkeypatch.setattr(decontam, "BROADCAST_HITS", bound)
    rows, items = leaks(spark)
    docs, bench = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(docs, bench).collect()
    want = brute_leaks(rows, items)
    assert len(want) > 15 and sorted((str(r[0]), str(r[1]), r[2], r[3]) for r in got) == want
    kept = decontam.remove(docs, bench)
    assert kept.columns == docs.columns
    bad = {(d, r[1]) for d in {w[0] for w in want} for r in rows if str(r[0]) == d and brute_leaks([r], items)}
    assert sorted((str(r[0]), r[1] or "") for r in kept.collect()) == sorted((str(r[0]), r[1] or "") for r in rows if (str(r[0]), r[1]) not in bad)


def test_masks_lose_nothing_that_the_rule_accepts():
    """Every pattern of substitutions that the rule accepts leaves some window and mask whole, at every item length."""
    for n in range(1, decontam.SPAN + 1):
        errors = n - math.ceil(n * decontam.SHARE)
        for e in range(errors + 1):
            for lost in itertools.combinations(range(n), e):
                assert any(all(p + i not in lost for i in mask) for _, width, mask in decontam.masks_of(n) for p in range(n - width + 1)), (n, lost)


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", "mine"), (2, "x", "yours")], "doc_id long, text string, __key string")
    bench = spark.createDataFrame([(7, "a b c d e f g h i j")], "item_id long, text string")
    assert [tuple(r) for r in decontam.remove(docs, bench).collect()] == [(2, "x", "yours")]


def test_no_documents_or_items(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c", "en", "s", 1, 1, 1)], DOCS)
    assert decontam.contaminated(docs, bench).count() == 0 and decontam.remove(some, bench).count() == 1


def test_short_items_tolerate_what_the_rule_grants(spark):
    rng = random.Random(6)
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in range(1, 10)]
    rows = []
    for n, t in items:
        for lost in range(n + 1):
            w = ["other" if i == lost else x for i, x in enumerate(t.split())]
            rows.append((len(rows), " ".join(["some", *w, rng.choice(["more", "words"])]), "en", "s", 1, 1, 1))
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r[0]), str(r[1]), r[2], r[3]) for r in decontam.contaminated(docs, bench).collect())
    assert got == brute_leaks(rows, items) and len(got) == 9 + 5 + 6 + 7 + 8 + 9


@pytest.mark.parametrize("kind", ["one", "own words", "a shared word", "empty"])
def test_small_tables_without_a_frequent_word(spark, kind):
    texts = {
        "one": ["alpha beta"],
        "own words": [f"w{i} v{i}" for i in range(200)],
        "a shared word": [f"same w{i}" for i in range(12)],
        "empty": [""] * 300 + ["alpha"] * 2,
    }[kind]
    got = bm25.search(spark.createDataFrame([(20 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    found = {(r["query_id"], r["doc_id"]) for r in got}
    if kind == "a shared word":
        assert all(sum(q == 20 * i for q, _ in found) == 10 and (20 * i, 20 * i) in found for i in range(12))
    elif kind == "empty":
        assert found == {(a, b) for a in (6000, 6020) for b in (6000, 6020)}
    else:
        assert found == {(20 * i, 20 * i) for i in range(len(texts))}


def test_a_partition_of_several_shards_is_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_DOCS", 7)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 30, 90])))) for i in range(120)], "doc_id long, text string").coalesce(1)
    want = sorted(tuple(r) for r in bm25.search(docs).collect())
    assert sorted(tuple(r) for r in bm25.search(docs, shard_postings=40).collect()) == want
    index = bm25.forward_index(docs).where("size(terms) > 0").select("doc_id", "dl", "terms", "tfs")
    queries = bm25.stage_table(spark.createDataFrame([], "qid long, term long, idf double, least double, least_id long"), "none")
    assert bm25.search_shards(index, queries, 10.0, 10, 40).count() == 0
