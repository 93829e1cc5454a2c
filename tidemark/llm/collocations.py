"""Phrase collocations by hashed bucket counts (PCY / DHP), Apriori pruning and exact counts.

Frequent phrases are found length by length. The pass that counts phrases of n words exactly also adds every occurrence of
a phrase of n + 1 words, whose two parts of n words both came through, to one of BUCKETS counters. The next pass counts an
occurrence exactly only if its bucket reached the support and both its parts of n words are frequent; both are looked up in
bitmaps of BUCKETS bits, broadcast whatever the corpus (2 MB each). Bitmaps err on one side alone: a phrase that is frequent
always comes through, and what else does is counted and dropped, so the result is exact for any number of buckets.

Scale. A task counts phrases block by block and its counters as bytes held at the support, which is all that the next pass
asks; they are compressed and summed by stretch of buckets, so a task's counters cost a few megabytes whatever it reads.
Counts are summed before the shuffle, and no task holds more than one block of a text. Parts that very many phrases share
are joined by a broadcast of at most HOT rows, and the phrases of a language are ranked in SALTS groups first, so neither a
common word nor a language that has most of the corpus makes a large task. Every pass is a table in the shared folder.

Defined results: a null text counts as empty, a null language as `und`; a text without words counts nothing; repeated rows
count each; equal scores and counts go by the bytes of the phrase; bytes that are not UTF-8 are read as U+FFFD; an empty
table gives an empty result; columns besides text and lang are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_hot, stage_path

SUPPORT, LONGEST, TOP, SCALE, COVER = 30, 4, 2000, 2_000_000, 80
#: Counters of a pass as a power of two, and the stretches in which they are summed.
BITS, STRETCHES = 24, 256
#: Bytes of text handled at a time (also the longest part of one text), bytes held over all languages, words remembered.
BLOCK, HELD, WORDS = 4 << 20, 32 << 20, 1_000_000
SALTS = 64

_CUT = re.compile(rb"[ \t.,;:!?\n-\r]")
#: A-Z to lower case, everything that ends a piece to one full stop.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_STEP, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _hashes(words: np.ndarray, lang: int, longest: int) -> list[np.ndarray]:
    """Hashes of the phrases of 1, 2, ... words from each place, from the words' own hashes."""
    out = [_mixed(words + np.uint64(lang))]
    for n in range(2, longest + 1):
        out.append(_mixed(out[-1][: max(0, len(words) - n + 1)] * _STEP + words[n - 1 :]))
    return out


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _pack(counts: np.ndarray, support: int):
    """(stretch, counters) of the stretches that are not all zero; counters are held at the support."""
    zip_, size = zstandard.ZstdCompressor(level=1), len(counts) // STRETCHES
    kind = np.uint8 if support < 256 else np.uint32
    for s in range(STRETCHES):
        part = counts[s * size : (s + 1) * size]
        if part.any():
            yield s, zip_.compress(np.minimum(part, support).astype(kind).tobytes())


class _Words(dict):
    """Ids of words in the order in which they are first seen; the piece end has 0."""

    def __init__(self):
        super().__init__({b".": 0})
        self.hashes = np.zeros(1024, np.uint64)
        self.hashed = 1

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1

    def known(self) -> np.ndarray:
        """Hashes by id."""
        if len(self) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(max(len(self), len(self.hashes)), np.uint64)])
        if self.hashed < len(self):
            fresh = list(self)[self.hashed :]
            self.hashes[self.hashed : len(self)] = np.fromiter(map(xxhash.xxh64_intdigest, fresh), np.uint64, len(fresh))
            self.hashed = len(self)
        return self.hashes


class _Pass:
    """What one task counts in the pass of phrases of n words."""

    def __init__(self, n: int, parts: np.ndarray | None, buckets: np.ndarray | None, following: bool):
        self.n, self.parts, self.buckets = n, parts, buckets
        self.next = np.zeros(1 << BITS, np.uint32) if following else None
        self.words = _Words()
        self.found: list[tuple[str, list[bytes], np.ndarray]] = []

    def block(self, lang: str, words: list[bytes], carried: int) -> None:
        """Counts the phrases of a run of words, but for those within the first `carried` ones, which were counted before."""
        n, size = self.n, len(words)
        if size < n:
            return
        if len(self.words) > WORDS:
            self.words = _Words()
        w = np.fromiter(map(self.words.__getitem__, words), np.int64, size)
        h = _hashes(self.words.known()[w], xxhash.xxh64_intdigest(lang.encode()), n + (self.next is not None))
        word = w != 0
        whole = word
        for k in range(1, n):
            whole = whole[:-1] & word[k:]
        if self.parts is not None:
            parts = self.parts[_bucket(h[n - 2])]
            whole &= parts[:-1] & parts[1:] & self.buckets[_bucket(h[n - 1])]
        at = np.flatnonzero(whole)
        at = at[at > carried - n]
        if len(at):
            key = w[at]
            for k in range(1, n):  # exact names: the id of the first words and the next word
                key = np.unique(key, return_inverse=True)[1] * np.int64(1 << 31) + w[at + k]
            _, first, counts = np.unique(key, return_index=True, return_counts=True)
            self.found.append((lang, [b" ".join(words[i : i + n]) for i in at[first].tolist()], counts))
        if self.next is not None and size > n:
            at = np.flatnonzero(whole[:-1] & whole[1:])
            np.add.at(self.next, _bucket(h[n][at[at > carried - n - 1]]), 1)

    def text(self, lang: str, data: bytes) -> None:
        """Counts a text in parts that end at a word's end; the last words of a part begin the next one."""
        at, carry = 0, []
        while at < len(data):
            m = _CUT.search(data, at + BLOCK) if len(data) > at + BLOCK else None
            end = m.start() if m else len(data)
            words = carry + data[at:end].translate(_PLAIN).replace(b".", b" . ").split()
            self.block(lang, words, len(carry))
            at, carry = end, words[-self.n :]

    def batch(self) -> pa.RecordBatch:
        """The phrases counted since the last call."""
        langs = [x for lang, phrases, _ in self.found for x in [lang] * len(phrases)]
        phrases = [p for _, some, _ in self.found for p in some]
        counts = np.concatenate([c for *_, c in self.found]) if self.found else np.zeros(0, np.int64)
        self.found = []
        none = pa.nulls(len(langs))
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names=_NAMES)


_NAMES = ["lang", "phrase", "n", "stretch", "counters"]
_SCHEMA = "lang string, phrase string, n long, stretch int, counters binary"


def _stretches(counts: np.ndarray, support: int) -> pa.RecordBatch:
    rows = list(_pack(counts, support))
    none = pa.nulls(len(rows))
    columns = [none.cast(pa.string()), none.cast(pa.string()), none.cast(pa.int64()), pa.array([s for s, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())]
    return pa.record_batch(columns, names=_NAMES)


def _count(docs: DataFrame, n: int, support: int, parts, buckets, following: bool) -> DataFrame:
    """One pass over all texts: rows (lang, phrase, n) of phrases of n words, and rows (stretch, counters) for the next length."""

    def run(batches):
        bit = lambda b: np.unpackbits(np.frombuffer(b.value, np.uint8)).astype(bool) if b is not None else None
        own, held, total = _Pass(n, bit(parts), bit(buckets), following), defaultdict(list), 0
        sizes: dict[str, int] = defaultdict(int)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if len(text) > BLOCK:
                    own.text(lang, text)
                elif text:
                    held[lang].append(text)
                    sizes[lang] += len(text)
                    total += len(text)
                    if sizes[lang] >= BLOCK or total >= HELD:
                        for key in [lang] if sizes[lang] >= BLOCK else list(held):
                            total -= sizes.pop(key)
                            own.text(key, b".".join(held.pop(key)))
                if own.found:
                    yield own.batch()
        for key, texts in held.items():
            own.text(key, b".".join(texts))
        yield own.batch()
        if following:
            yield _stretches(own.next, support)

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text"))
    return texts.mapInArrow(run, _SCHEMA)


def _bitmap(rows: DataFrame, support: int):
    """The buckets whose counters sum up to the support, as a broadcast bitmap of 2^BITS bits."""

    def run(batches):
        kind, sums = np.uint8 if support < 256 else np.uint32, {}
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(unzip.decompress(c), kind)
                sums[s] = np.minimum(sums[s] + part, support) if s in sums else part.astype(np.uint32)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([np.packbits(x >= support).tobytes() for x in sums.values()], pa.binary())], names=["stretch", "bits"])

    stretches = rows.where("stretch IS NOT NULL").select("stretch", "counters").repartition("stretch").mapInArrow(run, "stretch int, bits binary")
    size = (1 << BITS) // STRETCHES // 8
    out = bytearray(size * STRETCHES)
    for r in stretches.collect():  # STRETCHES rows of a fixed size
        out[r["stretch"] * size : (r["stretch"] + 1) * size] = r["bits"]
    return rows.sparkSession.sparkContext.broadcast(bytes(out))


def _members(phrases: DataFrame, n: int):
    """A bitmap of phrases of n words."""

    def run(batches):
        seen = np.zeros(1 << BITS, np.uint8)
        for b in batches:
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                words = np.fromiter(map(xxhash.xxh64_intdigest, phrase.split(b" ")), np.uint64, n)
                seen[_bucket(_hashes(words, xxhash.xxh64_intdigest(lang.encode()), n)[-1])] = 1
        yield _stretches(seen, 1)

    return _bitmap(phrases.select("lang", "phrase").mapInArrow(run, _SCHEMA), 1)


def frequent(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """([(lang, phrase, f) of 1, 2, ... words], (lang, n)): exact counts of all phrases with f >= support, and of all words.
    All are tables in the shared folder."""
    spark = docs.sparkSession
    found, totals, parts, buckets = [], None, None, None
    for n in range(1, longest + 1):
        at = stage_path(_count(docs, n, support, parts, buckets, n < longest), f"pass{n}")
        rows = spark.read.parquet(at)
        counted = rows.where("phrase IS NOT NULL")
        if n == 1:
            totals = spark.read.parquet(stage_path(counted.groupBy("lang").agg(F.sum("n").alias("n")), "words"))
        exact = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= support)
        found.append(spark.read.parquet(stage_path(exact, f"phrases{n}")))
        if n < longest:
            for old in (parts, buckets):
                if old is not None:
                    old.destroy()
            parts, buckets = _members(found[-1], n), _bitmap(rows, support)
        discard(spark, at)
    return found, totals


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two or more words of each language. A phrase is cut in two
    where it scores lowest, and dropped if a longer frequent phrase around it has `cover` hundredths of its count."""
    found, totals = frequent(docs, support, longest)
    every = found[0].withColumn("size", F.lit(1))
    for n, f in enumerate(found[1:], 2):
        every = every.unionByName(f.withColumn("size", F.lit(n)))
    phrases = every.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("w"))

    def inner(first, count):
        return F.array_join(F.slice("w", first, count), " ")

    # longer phrases speak for those inside them
    spans = [(i, k) for n in range(3, longest + 1) for k in range(2, n) for i in range(1, n - k + 2)]
    within = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in sorted(set(spans))) or [F.struct(F.lit(1).alias("i"), F.lit(9).alias("k"))]))
    longer = phrases.select("lang", "a", "size", "w", within.alias("s")).where("s.k < size AND s.i + s.k - 1 <= size")
    longer = longer.select("lang", inner(F.col("s.i"), F.col("s.k")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < cover * F.col("a"), F.lit(True)))

    cuts = kept.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    left, right = inner(F.lit(1), F.col("k")), inner(F.col("k") + 1, F.col("size") - F.col("k"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), left.alias("part")), F.struct(F.lit(1).alias("side"), right.alias("part"))))
    halves = cuts.select("lang", "phrase", "a", "k", sides.alias("h")).select("lang", "phrase", "a", "k", "h.side", F.struct("lang", "h.part").alias("key"))
    halves_at = stage_path(halves, "halves")
    halves = docs.sparkSession.read.parquet(halves_at)
    known = every.select(F.struct("lang", F.col("phrase").alias("part")).alias("key"), "f").join(halves.groupBy("key").agg(F.count("*").alias("n")), "key")
    priced = join_hot(halves, known, "key", halves.count())
    each = priced.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    share = F.expr(f"CAST(CAST({SCALE} AS DECIMAL(8, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0))) AS LONG)")
    worst = each.select("lang", "phrase", "a", F.struct(share.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    scored = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = f"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM docs),
words AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
    FROM words, range(1, {LONGEST + 1}) s(k) WHERE len(w) >= k),
counts AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {SUPPORT}),
total AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
longer AS (
    SELECT c.lang, array_to_string(list_slice(string_split(c.g, ' '), i, i + s - 1), ' ') AS g, max(c.f) AS around
    FROM counts c, range(2, {LONGEST}) a(s), range(1, {LONGEST}) b(i) WHERE s < c.k AND i + s - 1 <= c.k GROUP BY ALL),
kept AS (SELECT c.* FROM counts c LEFT JOIN longer o ON o.lang = c.lang AND o.g = c.g WHERE c.k > 1 AND (o.g IS NULL OR 100 * o.around < {COVER} * c.f)),
cuts AS (
    SELECT lang, g, f, j, array_to_string(list_slice(string_split(g, ' '), 1, j), ' ') AS x, array_to_string(list_slice(string_split(g, ' '), j + 1, k), ' ') AS y
    FROM kept, range(1, {LONGEST}) s(j) WHERE j < k),
priced AS (
    SELECT c.lang, c.g, c.f, c.j, x.f AS l, y.f AS r, (({SCALE}::HUGEINT * c.f::HUGEINT) // (x.f + y.f)::HUGEINT)::BIGINT AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.x JOIN counts y ON y.lang = c.lang AND y.g = c.y),
best AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, encode(g)) AS rank FROM best)
SELECT r.lang, r.rank::BIGINT AS rank, r.g AS phrase, r.f::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n::BIGINT AS n, r.score
FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= {TOP}"""
