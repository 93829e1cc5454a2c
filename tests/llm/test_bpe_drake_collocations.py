import hashlib
import random
import struct
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tidemark.llm import byte_bpe, collocations, drake

# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.VOCABULARY), special_tokens={})


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_ids_are_the_librarys(library):
    codec, rng = byte_bpe.codec(), random.Random(1)
    texts = ["", " ", "don't  stop\n\n 12345 <|endoftext|>", "a" * 5000, "ab" * 3000, "\x00\x1c\x85᠎ x", "\U0001f469‍\U0001f4bb 的一是 ՘Ᲊ\U00010940"]
    alphabets = ("ab", "etaoin shr", "0123456789.,- ", " \n\t\r\xa0x", "éßñ的一אب\U0001f600 1", "".join(map(chr, range(256))))
    texts += ["".join(rng.choice(a) for _ in range(rng.randrange(200))) for a in alphabets for _ in range(150)]
    texts += ["".join(chr(rng.randrange(0x110000)) for _ in range(200)).encode("utf-8", "ignore").decode() for _ in range(300)]
    for t in texts:
        assert ids(codec.encode(t)) == library.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()


def test_memos_may_be_emptied_at_any_time(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECES", 3)
    monkeypatch.setattr(byte_bpe, "PAIRS", 5)
    monkeypatch.setattr(byte_bpe, "HELD", 10)
    codec = byte_bpe.Codec(byte_bpe.read_ranks(byte_bpe.VOCABULARY))
    text = "It's the way that antidisestablishmentarianism isn't " * 20
    assert ids(codec.encode(text)) == library.encode_ordinary(text)


def test_a_vocabulary_out_of_order_is_refused():
    base = {bytes([b]): b for b in range(256)}
    assert ids(byte_bpe.Codec(base | {b"ab": 256, b"abc": 257}).encode("abcab")) == [257, 256]
    with pytest.raises(ValueError):  # its second part comes later
        byte_bpe.Codec(base | {b"abc": 256, b"bc": 257})
    with pytest.raises(ValueError):
        byte_bpe.Codec({b"a": 0})
    with pytest.raises(ValueError):
        byte_bpe.codec().decode(b"\x01\x00\x00")


def test_round_trip_of_a_table(spark, library):
    rows = [(1, None), (2, ""), (None, "x y"), (3, "Grüße,  Welt\n"), (3, "Grüße,  Welt\n"), (4, "z" * 300_000), (5, "lo ng " * 60_000)]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, ids int")
    got = sorted(tuple(r) for r in byte_bpe.round_trip(df).fillna(-1, "doc_id").collect())
    want = []
    for i, t in rows:
        own = library.encode_ordinary(t) if t and len(t) < 200_000 else None
        packed = struct.pack(f"<{len(own)}I", *own) if own is not None else byte_bpe.codec().encode(t or "")
        want.append((-1 if i is None else i, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert byte_bpe.round_trip(df.limit(0)).count() == 0
    parts = byte_bpe.decode(byte_bpe.encode(df)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], bytes(r["decoded"]).decode()) for r in parts) == sorted((str(i), w[1], t or "") for (i, t), w in zip(rows, want))


# ---------------------------------------------------------------- centroids


def slow_rounds(vectors, centroids, rounds):
    vectors, centroids = [list(map(int, v)) for v in vectors], [list(map(int, c)) for c in centroids]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for v in vectors]
        for k in range(len(centroids)):
            mine = [v for v, o in zip(vectors, own) if o == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    return [nearest(v)[::-1] for v in vectors], centroids


@pytest.mark.parametrize("kind", ["ties", "groups", "wide"])
def test_clusters_equal_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "ties":  # few values: many equal distances, repeated vectors, empty clusters
        x = rng.integers(0, 2, (120, 4)) / 256
    elif kind == "groups":
        x = (rng.integers(0, 9, (300, 1)) * 40 + rng.integers(0, 20, (300, 4))) / 256
    else:  # sums of products pass 2^53
        x = rng.integers(-(1 << 27), 1 << 27, (150, 4)) / 256
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found, centroids = drake.cluster(df, size=4, clusters=17, rounds=5)
    order = sorted(range(len(rows)), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:17]
    v = np.floor(x * 256).astype(np.int64)
    want, last = slow_rounds(v, v[order], 5)
    assert centroids.tolist() == last
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in found.collect()} == dict(enumerate(want))


def test_bounds_certify_only_what_is_certain():
    rng = np.random.default_rng(9)
    v = rng.integers(-50, 50, (400, 6))
    centroids = rng.integers(-50, 50, (24, 6))
    own, upper, near, lower = drake.scan(v, centroids, 6)
    skipped = 0
    for bounds in (6, 6, 4, 3, 3):
        moved = centroids + rng.integers(-2, 3, centroids.shape)
        moves = np.sqrt(((moved - centroids) ** 2).sum(1)) * (1 + drake.MARGIN)
        centroids = moved
        own, upper, near, lower, rank = drake.advance(v, own, upper, near, lower, centroids, moves, bounds)
        d = drake.squared(v, centroids)
        assert (own == d.argmin(1)).all() and (upper >= np.sqrt(d.min(1))).all()
        assert (lower[:, :-1] <= np.sqrt(np.take_along_axis(d, near, 1))).all()
        listed = np.column_stack([own, near])
        assert all(len(set(row)) == len(row) for row in listed.tolist())
        rest = d.astype(float)
        np.put_along_axis(rest, listed, np.inf, 1)
        assert (lower[:, -1] <= np.sqrt(rest.min(1))).all()
        skipped += int((rank == 0).sum())
    assert skipped > 100


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.25, 1.0]), (None, [0.5, 1.0]), (2, None), (3, [1.0]), (4, [nan, 0.0]), (5, [inf, 0.0]), (6, [None, 0.0]), (7, [1e30, -1e30])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    got = drake.assignments(df, size=2, clusters=40).collect()
    assert sorted((str(r["vec_id"]), r["distance"]) for r in got) == [("1", 0), ("1", 0), ("7", 0), ("None", 0)] and {r["inertia"] for r in got} == {0}
    only = drake.assignments(df.where("vec_id IS NULL"), size=2).collect()
    assert [tuple(r) for r in only] == [(None,) * 6]
    assert drake.assignments(df.limit(0), size=2).count() == 0


# ---------------------------------------------------------------- collocations


def slow_collocations(rows, support, top):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            total[lang] += len(w)
            for k in range(1, 5):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    some = {p: a for p, a in counts.items() if a >= support and len(p[1]) > 1}
    out = []
    for lang in total:
        found = []
        for (l, p), a in some.items():
            if l != lang or any(
                m == l and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (m, q), b in some.items()
            ):
                continue
            cuts = []
            for k in range(1, len(p)):
                x, y = counts[l, p[:k]], counts[l, p[k:]]
                cuts.append((int(Fraction(2_000_000 * a, x + y)), k, x, y))
            s, _, x, y = min(cuts)
            found.append((-s, -a, " ".join(p).encode(), x, y))
        for rank, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, total[lang], -s))
    return sorted(out)


def collocation_rows():
    rng = random.Random(8)
    words = ["the", "The", "New", "York", "city", "of", "É", "été", "\x00", "a\x1cb", "naïve", "x"]
    rows = [(None, None), ("en", ""), ("en", " \t\n..!"), (None, "und words"), ("und", "und words"), ("en", "one " * 90), ("fr", "w" * 5000)]
    for _ in range(150):
        w = [rng.choice(words[: rng.choice([4, 12])]) for _ in range(rng.randrange(80))]
        rows.append((rng.choice(["en", "en", "en", "fr", None]), "".join(x + rng.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for x in w)))
    return rows + [("en", "New York city of " * 40)] * 3


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_brute_force(spark, small):
    rows = collocation_rows()
    df = spark.createDataFrame([(i, t, g, 1) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase int").repartition(5)
    got = collocations.collocations(df, support=5 if small else 12, top=40)
    assert sorted(tuple(r) for r in got.collect()) == slow_collocations(rows, 5 if small else 12, 40)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_blocks_of_a_text_count_each_phrase_once(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 40)
    monkeypatch.setattr(collocations, "WORDS", 5)
    rng = random.Random(2)
    text = "".join(rng.choice(["aa", "b", "c", "dd"]) + rng.choice([" ", " ", ". "]) for _ in range(400)).encode()
    for n in (1, 2, 3, 4):
        own = collocations._Pass(n, None, None, False) if n == 1 else collocations._Pass(n, np.ones(1 << collocations.BITS, bool), np.ones(1 << collocations.BITS, bool), False)
        own.text("en", text)
        got = Counter()
        for _, phrases, counts in own.found:
            for p, c in zip(phrases, counts.tolist()):
                got[p] += c
        want = Counter()
        for piece in text.split(b"."):
            w = piece.split()
            want.update(b" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
        assert got == want


def test_counters_are_summed_over_tasks(spark):
    a, b = np.zeros(1 << collocations.BITS, np.uint32), np.zeros(1 << collocations.BITS, np.uint32)
    a[[5, 70_000, 1 << 20]], b[[5, 70_000]] = [20, 300, 29], [10, 1]
    rows = [(s, bytearray(c)) for x in (a, b) for s, c in collocations._pack(x, 30)]
    bits = collocations._bitmap(spark.createDataFrame(rows, "stretch int, counters binary"), 30)
    assert np.flatnonzero(np.unpackbits(np.frombuffer(bits.value, np.uint8))).tolist() == [5, 70_000]
