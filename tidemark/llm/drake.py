"""Centroid clustering (Lloyd's rounds) with Drake's adaptive distance bounds, exact in integers.

Vectors are integers, centroids too (floors of exact means), so squared distances are exact and ties are real: they go to
the centroid of the smaller number. A vector keeps, from round to round, its centroid, an upper bound of its distance, the
`bounds` next nearest centroids in order with a lower bound each, and one lower bound for all the rest. When the centroids
have moved, each bound is widened by the move of its centroid (the last by the largest move). Then

- if every lower bound is above the upper one, the centroid is certain without any distance;
- else the distance to the own centroid is made exact, and the bounds are compared again;
- if the first z lower bounds don't exceed it, the distances to these z centroids are made and only they are put in order;
- if not even the bound of the rest does, the order can't be certified and all centroids are scanned.

Bounds are doubles, rounded outward with a margin far over their rounding errors, so what they certify is certain. Their
number adapts: it starts at a quarter of the centroids and is lowered to the highest rank that any vector needed, but not
under an eighth.

Scale. A round is one pass over the vectors' own table in the shared folder, without a shuffle of vectors; the new
centroids need only the vectors that changed theirs: their components are added and subtracted by centroid and summed
before the shuffle, one row a centroid. Only centroids come to the driver. A round's table replaces the one before it.

Defined results: vectors of another size, or with a null or non-finite component, are left out, null vectors too; repeated
rows are kept and count each; a null vec_id is assigned but starts no centroid; rows that repeat a vec_id start centroids
in the order of their components; with fewer vectors than centroids each vector starts one; without any centroid cluster
and distance are null; an empty table gives an empty result. Components are held to +-2^27, as the distance of others does
not fit a long. Columns besides vec_id and embedding are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage_path

SIZE, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Largest absolute component: distances of SIZE of them fit a long. Up to EXACT, sums of products are exact in doubles.
LARGEST, EXACT = 1 << 27, 1 << 22
#: Relative margin of the bounds.
MARGIN = 1e-12


def integers(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<int>): floor(scale * x) of the vectors with exactly `size` finite components."""
    x = F.col("embedding")
    finite = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    held = F.transform(x, lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.lit(float(scale)) * c.cast("double")))).cast("int"))
    return vectors.where((F.size(x) == size) & finite).select("vec_id", held.alias("v"))


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows of v by centroids, as longs."""
    if len(v) and max(np.abs(v).max(), np.abs(centroids).max()) <= EXACT:
        v, centroids = v.astype(np.float64), centroids.astype(np.float64)
    else:
        v, centroids = v.astype(np.int64), centroids.astype(np.int64)
    # |v|^2 - 2vc + |c|^2; in longs an overflow on the way cancels out, as the result fits
    return ((v * v).sum(1)[:, None] - 2 * (v @ centroids.T) + (centroids * centroids).sum(1)[None, :]).astype(np.int64)


def _pairs(v: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to the centroid named for it."""
    d = v.astype(np.int64) - centroids[which]
    return (d * d).sum(1)


def scan(v: np.ndarray, centroids: np.ndarray, bounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nearest, distance bound, next nearest, lower bounds) of rows from all distances."""
    d = squared(v, centroids)
    order = np.argsort(d, axis=1, kind="stable")  # equal distances: smaller numbers first
    root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    lower = np.full((len(v), bounds + 1), np.inf)
    known = root[:, 1 : bounds + 2] * (1 - MARGIN)
    lower[:, : known.shape[1]] = known
    return order[:, 0], root[:, 0] * (1 + MARGIN), order[:, 1 : bounds + 1], lower


def advance(v, own, upper, near, lower, centroids, moves, bounds):
    """One round for a block of vectors: (own, upper, near, lower, rank), rank being the number of bounds that did not certify
    the order. The number of bounds may be lower than before."""
    near = near[:, :bounds]
    if lower.shape[1] > bounds + 1:  # the bounds given up join the rest
        lower = np.column_stack([lower[:, :bounds], lower[:, bounds:].min(1)])
    upper = (upper + moves[own]) * (1 + MARGIN)
    step = np.column_stack([moves[near], np.full(len(v), moves.max(initial=0.0))])
    lower = lower - step - MARGIN * (lower + step)
    lower = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]  # no bound is above a later one
    lower = np.where(np.isnan(lower), np.inf, lower)
    own, near, rank = own.copy(), near.copy(), (lower <= upper[:, None]).sum(1)
    unsure = np.flatnonzero(rank)
    best = _pairs(v[unsure], centroids, own[unsure])
    upper[unsure] = np.sqrt(best.astype(np.float64)) * (1 + MARGIN)
    rank[unsure] = (lower[unsure] <= upper[unsure, None]).sum(1)
    some = unsure[(rank[unsure] > 0) & (rank[unsure] <= near.shape[1])]
    if len(some):
        listed = np.column_stack([own[some], near[some]])
        d = np.full(listed.shape, np.iinfo(np.int64).max)
        for j in range(listed.shape[1]):
            rows = np.flatnonzero(rank[some] >= j)
            d[rows, j] = _pairs(v[some[rows]], centroids, listed[rows, j])
        # those whose distance was made come first, by distance and number; the others keep their places
        made = np.arange(listed.shape[1])[None, :] <= rank[some][:, None]
        place = np.where(made, 0, np.arange(listed.shape[1])[None, :])
        order = np.lexsort((listed, d, place), axis=1)
        listed, d = np.take_along_axis(listed, order, 1), np.take_along_axis(d, order, 1)
        root = np.sqrt(d.astype(np.float64))
        own[some], near[some], upper[some] = listed[:, 0], listed[:, 1:], root[:, 0] * (1 + MARGIN)
        lower[some, : near.shape[1]] = np.where(made[:, 1:], root[:, 1:] * (1 - MARGIN), lower[some, : near.shape[1]])
    rest = unsure[rank[unsure] > near.shape[1]]
    if len(rest):
        own[rest], upper[rest], near[rest], lower[rest] = scan(v[rest], centroids, bounds)
    return own, upper, near, lower, rank


def _lists(a: np.ndarray, kind) -> pa.Array:
    """Rows of a matrix as lists."""
    offsets = np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(a).ravel(), kind))


def _matrix(column, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, len(flat) // rows if rows else 0)


def _round(state: DataFrame, centroids: np.ndarray, moves: np.ndarray | None, bounds: int) -> DataFrame:
    """The next state; the first is made from (vec_id, v) by a scan of all centroids."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            v = _matrix(b.column("v"), n).astype(np.int64)
            if moves is None or not n:
                before = pa.nulls(n, pa.int32())
                own, upper, near, lower = scan(v, centroids, bounds)
                rank = np.zeros(n, np.int64)
            else:
                before = b.column("own")
                own = before.to_numpy(zero_copy_only=False).astype(np.int64)
                near, lower = _matrix(b.column("near"), n).astype(np.int64), _matrix(b.column("lower"), n)
                own, upper, near, lower, rank = advance(v, own, b.column("upper").to_numpy(zero_copy_only=False), near, lower, centroids, moves, bounds)
            columns = {
                "vec_id": b.column("vec_id"), "v": b.column("v"), "before": before, "own": pa.array(own, pa.int32()), "upper": pa.array(upper),
                "near": _lists(near, pa.int32()), "lower": _lists(lower, pa.float64()), "rank": pa.array(rank, pa.int32()),
            }
            yield pa.record_batch(list(columns.values()), names=list(columns))

    kind = state.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, v array<int>, before int, own int, upper double, near array<int>, lower array<double>, rank int"
    return state.mapInArrow(run, schema)


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in the order of the hashes."""
    named = vectors.where(F.col("vec_id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return np.array([r["v"] for r in named.orderBy("h", "v").limit(clusters).collect()], np.int64)


def changes(state: DataFrame, size: int) -> DataFrame:
    """(cluster, n, s0, s1, ...): what each centroid's count and sums gain by the vectors that changed theirs."""
    moved = state.where(~F.col("own").eqNullSafe(F.col("before")))
    both = F.array(F.struct(F.col("own").alias("cluster"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("cluster"), F.lit(-1).alias("sign")))
    each = moved.select("v", F.explode(both).alias("c")).select("v", "c.*").where("cluster IS NOT NULL")
    return each.groupBy("cluster").agg(F.sum("sign").alias("n"), *(F.sum(F.col("v")[i].cast("long") * F.col("sign")).alias(f"s{i}") for i in range(size)))


def cluster(vectors: DataFrame, size: int = SIZE, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, v, cluster, distance), centroids): every kept vector with its centroid after `rounds` rounds, and the centroids.
    The frame reads a table in the shared folder."""
    spark = vectors.sparkSession
    at = stage_path(integers(vectors, size, scale), "vectors")
    state = spark.read.parquet(at)
    centroids = first_centroids(state, clusters, seed)
    if not len(centroids):
        return state.select("vec_id", "v", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), centroids
    count, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), size), np.int64)
    bounds, moves = min(len(centroids) - 1, max(1, len(centroids) // 4)), None
    for r in range(rounds + 1):
        following = stage_path(_round(state, centroids, moves, bounds), f"round{r}")
        discard(spark, at)
        at, state = following, spark.read.parquet(following)
        if r == rounds:
            break
        for row in changes(state, size).collect():  # one row a centroid
            count[row["cluster"]] += row["n"]
            sums[row["cluster"]] += [row[f"s{i}"] for i in range(size)]
        moved = centroids.copy()
        full = count > 0
        moved[full] = sums[full] // count[full, None]
        moves = np.sqrt(((moved - centroids) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)
        centroids = moved
        if r:
            need = state.agg(F.max("rank")).first()[0] or 0
            bounds = min(bounds, max(1, len(centroids) // 8, need))
    rows = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "own int, c array<long>")
    part = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    done = state.select("vec_id", "v", "own").join(F.broadcast(rows), "own")
    return done.select("vec_id", "v", F.col("own").alias("cluster"), part.alias("distance")), centroids


def assignments(vectors: DataFrame, **parameters) -> DataFrame:
    """(vec_id, cluster int, distance, cluster_inertia, inertia long, centroid_sha256)."""
    found, centroids = cluster(vectors, **parameters)
    digests = [(k, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    named = found.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = per.agg(F.sum("cluster_inertia").alias("inertia"))
    small = F.broadcast(per.crossJoin(F.broadcast(total)).join(named, "cluster"))  # one row a centroid
    out = found.select("vec_id", "cluster", "distance").join(small, "cluster", "left")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    far = "list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))"
    nearest = f"SELECT rid, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d)::BIGINT AS d FROM (SELECT k.rid, c.c, {far} AS d FROM kept k, c%d c) GROUP BY rid"
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: greatest(-{LARGEST}, least({LARGEST}, floor({SCALE} * x::DOUBLE)))::BIGINT) AS v
    FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM
    (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY 1, 2 LIMIT {CLUSTERS}))""",
    ]
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({nearest % r})")
        steps.append(f"""m{r} AS MATERIALIZED (SELECT c, list(f ORDER BY i) AS v FROM (
    SELECT a.c, i, ((sum(k.v[i])::HUGEINT - ((sum(k.v[i])::HUGEINT % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS f FROM a{r} a JOIN kept k USING (rid), range(1, {SIZE + 1}) g(i) GROUP BY a.c, i) GROUP BY c)""")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (c))")
    steps.append(f"a{ROUNDS} AS MATERIALIZED ({nearest % ROUNDS})")
    text = ",\n".join(steps)
    return f"""WITH {text}
SELECT k.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept k LEFT JOIN a{ROUNDS} a USING (rid) LEFT JOIN c{ROUNDS} c ON c.c = a.c"""


ORACLE_SQL = _oracle()
