"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints have 64 bits over the XXH64 values (seed 42) of a text's 4-word shingles. Two fingerprints link at LIMIT or
fewer differing bits; components of the links are the duplicate classes.

Search. The 64 bits are divided into partitions and partition i gets a threshold t_i (at least -1: not probed) with
sum(t_i + 1) = LIMIT + 1. If two fingerprints differed in more than t_i bits in every partition, they would differ in
more than LIMIT bits, so every link agrees up to t_i bits in some partition. Bits that are correlated over the corpus go
to the same partition, which keeps the others selective, and a dynamic program picks the thresholds, and the number of
partitions, with the fewest expected rows and comparisons; both use bit and bit-pair counts over all fingerprints.
Each distinct fingerprint is sent to the buckets of all values within t_i / 2 bits (rounded up) of its own in the
partition, where any two that agree up to t_i bits meet, and buckets are verified on all 64 bits.

Scale. Equal fingerprints are collapsed before the search, so exact copies cost one row however many there are. Inside a
bucket a search absorbs what it has linked, so a bucket yields fewer edges than it has rows instead of all its pairs. A
bucket of more than BLOCK rows is dealt to one task for each pair of its blocks. Components come from alternating
large-star and small-star rounds over edges only; each round is a table in the shared folder.

Defined results: null, empty and blank texts have the fingerprint zero and link like any other; repeated rows are kept
and share a class; a null doc_id takes part and never becomes a class id unless its whole class has none; an empty table
gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, stage_table, unused

WORDS, SEED, BITS, LIMIT = 4, 42, 64, 4
#: Rows of a bucket that one task compares; larger buckets are divided into blocks, and every pair of blocks is compared.
BLOCK = 8192
#: Up to so many ids of dropped documents are broadcast (under 20 MB).
BROADCAST_IDS = 500_000
#: Relative costs of a shuffled probe row and of one comparison of two fingerprints in a bucket.
ROW_COST, PAIR_COST = 1.0, 0.004

_UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = _TOKEN.findall((text or "").encode("utf-8", "surrogatepass").translate(_UPPER))
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: -WORDS + 1].tolist(), ends[WORDS - 1 :].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    value = 0
    for bit in np.flatnonzero(2 * ones > len(hashes)).tolist():
        value |= 1 << bit
    return value


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, th): fp is the fingerprint's 64 bits as a signed long, th a hash that tells texts of one id apart."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp), b.column(2)], names=["doc_id", "fp", "th"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, fp long, th long")


# ---------------------------------------------------------------- the plan of the search


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 matrix of how many have both bits, over all rows: one small row a task."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            x = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(x), both + x.T @ x
        yield pa.record_batch([pa.array([n]), pa.array([both.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "both"])

    per_task = distinct.select("fp").mapInArrow(run, "n long, both array<double>")
    cells = per_task.select("n", F.posexplode("both").alias("cell", "c")).groupBy("cell").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    rows = cells.collect()  # 4,096 rows whatever the input
    both = np.zeros(BITS * BITS)
    for r in rows:
        both[r["cell"]] = r["c"]
    return (int(rows[0]["n"]) if rows else 0), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Partitions of near equal size; each is grown from the free bit with the strongest correlations by the bit most
    correlated with it so far. Ties go to the lower bit."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    corr = corr.round(3)
    free, out = list(range(BITS)), []
    for k in range(parts):
        want = BITS // parts + (k < BITS % parts)
        own = [max(free, key=lambda b: (corr[b, free].sum().round(3), -b))]
        free.remove(own[0])
        while len(own) < want:
            own.append(max(free, key=lambda b: (corr[b, own].sum().round(3), -b)))
            free.remove(own[-1])
        out.append(tuple(sorted(own)))
    return out


def expected_share(n: int, both: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """Estimated share of pairs that differ in at most 0, 1, ... LIMIT bits of the partition."""
    p = np.diag(both)[list(bits)] / max(n, 1)
    dist = np.zeros(LIMIT + 1)
    dist[0] = 1
    for q in 2 * p * (1 - p):
        dist = dist * (1 - q) + np.concatenate([[0], dist[:-1]]) * q
    return np.cumsum(dist)


def plan(n: int, both: np.ndarray) -> list[Part]:
    """The cheapest partitions and thresholds for n fingerprints with these bit counts."""
    best: tuple[float, list[Part]] | None = None
    for parts in range(2, LIMIT + 2):
        groups = group_bits(n, both, parts)
        # table[s]: least cost of the groups so far with sum(threshold + 1) = s
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits in groups:
            share, step = expected_share(n, both, bits), {}
            probes = np.cumsum([1, *(_choose(len(bits), e) for e in range(1, LIMIT + 1))])
            for s, (cost, chosen) in table.items():
                for t in range(-1, LIMIT - s + 1):
                    # both sides probe the values within r bits, and so meet if they are up to 2r bits apart, most of them twice
                    r = (t + 1) // 2
                    more = 0.0 if t < 0 else ROW_COST * n * probes[r] + PAIR_COST * n * n * share[min(LIMIT, 2 * r)]
                    if s + t + 1 not in step or cost + more < step[s + t + 1][0]:
                        step[s + t + 1] = (cost + more, (*chosen, t))
            table = step
        cost, chosen = table[LIMIT + 1]
        if best is None or cost < best[0]:
            best = (cost, [Part(b, t) for b, t in zip(groups, chosen) if t >= 0])
    return best[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


# ---------------------------------------------------------------- probe and verify


def _masks(part: Part) -> np.ndarray:
    """All changes of up to half the threshold, rounded up, of the partition's bits, as 64-bit masks: two values that
    differ in up to threshold bits have a changed value in common."""
    flips = np.array([0], np.uint64)
    for _ in range((part.threshold + 1) // 2):
        flips = np.unique(np.concatenate([flips, *(flips ^ np.uint64(1 << b) for b in part.bits)]))
    return flips


def probe(distinct: DataFrame, parts: list[Part]) -> DataFrame:
    """(part, key, fp): a row for each bucket that a fingerprint belongs to."""
    kept = [np.uint64(sum(1 << b for b in p.bits)) for p in parts]
    masks = [_masks(p) for p in parts]

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i, (keep, flips) in enumerate(zip(kept, masks)):
                for at in range(0, len(fp), 4096):
                    x = fp[at : at + 4096]
                    keys = ((x & keep)[:, None] ^ flips[None, :]).ravel()
                    yield pa.record_batch(
                        [pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.repeat(x, len(flips)).view(np.int64))],
                        names=["part", "key", "fp"],
                    )

    return distinct.select("fp").mapInArrow(run, "part int, key long, fp long")


def _absorb(x: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of one bucket: fewer than its rows, as a row that is linked leaves the search."""
    out, free = [], x
    while len(free) > 1:
        queue, free = [free[0]], free[1:]
        while queue and len(free):
            at = queue.pop()
            near = np.bitwise_count(free ^ at) <= LIMIT
            if near.any():
                got = free[near]
                out += [(int(at), g) for g in got.tolist()]
                queue += list(got)
                free = free[~near]
    return out


def bucket_links(keys: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of every run of equal keys: small runs all at once, by offset; larger ones one by one."""
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(cut, len(keys)))
    out: list[tuple[int, int]] = []
    small = np.repeat(sizes <= 24, sizes)
    k, f = keys[small], fp[small]
    for d in range(1, 24):
        if len(k) <= d:
            break
        same = k[d:] == k[:-d]
        hit = np.flatnonzero(same & (np.bitwise_count(f[d:] ^ f[:-d]) <= LIMIT))
        out += zip(f[hit].tolist(), f[hit + d].tolist())
    for a, n in zip(cut[sizes > 24].tolist(), sizes[sizes > 24].tolist()):
        out += _absorb(fp[a : a + n])
    return out


def links(distinct: DataFrame, parts: list[Part]) -> DataFrame:
    """(a, b): links whose components are those of all links between the distinct fingerprints."""
    rows = probe(distinct, parts)
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n"))
    hot = sizes.where(F.col("n") > BLOCK).select("part", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    if hot.isEmpty():
        dealt = rows.withColumn("pair", F.lit(0).cast("long"))
    else:
        # block i of a hot bucket meets every block j in the task of the pair (min, max)
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        dealt = (
            rows.join(hot, ["part", "key"], "left")
            .withColumn("own", F.coalesce(block, F.lit(0)))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
            .withColumn("pair", F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other"))
        )

    def run(batches):
        rest = [np.zeros(0, np.int64)] * 2
        last = None

        def done(keys, fp):
            found = bucket_links(keys, fp.view(np.uint64))
            a = np.array([x for x, _ in found], np.uint64).view(np.int64)
            b = np.array([y for _, y in found], np.uint64).view(np.int64)
            return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            part, key, pair, fp = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            if not len(fp):
                continue
            # number the runs of (part, key, pair); rows come sorted by them
            new = np.concatenate([[last != (part[0], key[0], pair[0])], (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
            run_no = np.cumsum(new) + (rest[0][-1] if len(rest[0]) else 0)
            last = (part[-1], key[-1], pair[-1])
            keys, fps = np.concatenate([rest[0], run_no]), np.concatenate([rest[1], fp])
            end = np.searchsorted(keys, keys[-1])
            yield done(keys[:end], fps[:end])
            rest = [keys[end:], fps[end:]]
        if len(rest[0]):
            yield done(*rest)

    order = ["part", "key", "pair"]
    sorted_rows = dealt.select(*order, "fp").repartition(*order).sortWithinPartitions(*order)
    found = sorted_rows.mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component. Alternating large-star and small-star rounds until
    nothing changes; every round is written to the shared folder and read back."""

    def spread(e: DataFrame, small: bool, rows: int) -> DataFrame:
        if small:  # each node's smaller neighbours and itself link to the smallest of them
            least = e.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
            got = join_hot(e, least, "b", rows)
            return got.select(F.col("a").alias("x"), "m").union(least.select(F.col("b").alias("x"), "m"))
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        # the centre of a large star is a key of very many rows
        return join_hot(both.where("b > a"), least, "a", rows).select(F.col("b").alias("x"), "m")

    def mark(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    e = stage_table(edges, "links")
    seen = mark(e)
    while seen[0]:
        for small in (False, True):
            e = spread(e, small, seen[0]).where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        e = stage_table(e, "links")
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, th, root, component_id) for every row of docs; root names the class of its fingerprint."""
    marked = stage_table(fingerprints(docs), "fingerprints")
    distinct = stage_table(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "distinct")
    n, both = bit_counts(distinct)
    if not n:
        return marked.withColumns({"root": F.col("fp"), "component_id": F.col("doc_id")})
    roots = stage_table(components(links(distinct, plan(n, both))), "components")
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    named = stage_table(named, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    per_fp = join_hot(named, least, "root", n).select("fp", "root", "component_id", F.col("copies").alias("n"))
    rows = named.agg(F.sum("copies")).first()[0]
    return join_hot(marked, stage_table(per_fp, "classes"), "fp", rows).select("doc_id", "fp", "th", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id for every row of docs."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns unchanged, that are the first of their class: one row for each class.

    A row is named by its doc_id and a hash of its text, and the first of a class has the smallest such name, ids that are
    null last; of rows with the same name one stays. The names to drop are broadcast while they are few (a checked bound),
    and else joined by a shuffle.
    """
    found = stage_table(classes(docs), "classes")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    firsts = found.groupBy("root").agg(F.min(name).alias("f")).select(F.col("f.doc_id").alias("id"), F.col("f.th").alias("first"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("first"))
    names = found.groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    drop = stage_table(names.join(firsts, same, "left_anti"), "drop")
    repeated = not names.where("n > 1").isEmpty()
    th, key, other = (unused(docs, c) for c in ("th", "key", "other"))
    out = drop.select(F.col("doc_id").alias(key), F.col("th").alias(other))
    out = F.broadcast(out) if drop.count() <= BROADCAST_IDS else out
    kept = docs.withColumn(th, F.xxhash64("text"))
    kept = kept.join(out, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(th) == F.col(other)), "left_anti")
    kept = kept.dropDuplicates(["doc_id", th]) if repeated else kept
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
