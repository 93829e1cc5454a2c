"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Source s is to have the share w_s of ``budget`` characters. With c_s characters it is repeated at the mean rate
budget * w_s / c_s, and each document gets a Poisson number of copies with that mean: its seeded hash, read as a number
u in [0, 1), is inverted through the distribution's cumulative sums. So a document's copies depend on its id, its text, the
seed and its source's rate alone: any task that is run again decides the same, and no state is kept for the whole corpus.

Copies are shuffled globally by a hash of id, text and copy: the hash is uniform, so hash partitions sorted inside by it are a
random order of the whole, without the sampling pass of a range sort, and a hot document or source is spread over all
partitions.

Defined results: a null source is a source of its own (named ``null_name``); a null text counts as empty; sources whose
weight is 0, or which have no characters, get no copies; rows without an id, or that share one, are told apart by their
texts; rows that repeat id and text get equal counts each; an empty table gives an empty result; all columns of the
documents are kept, and where one is named copy or shuffle_key, the result's own gets an underscore at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

SEED = "mix-1"
#: A table of rates up to this many sources is broadcast (tens of MB at most); a larger one is joined by a salted shuffle.
BROADCAST_SOURCES, SALTS = 20_000, 32
#: Means above this are drawn as sums of independent draws, as exp(-mean) and the sums lose precision beyond.
PART_MEAN = 32.0
#: Target weights of the registered query: src0, the hot source, is held to a tenth, and all others share alike.
WEIGHTS, OTHER = {"src0": 2.0, "src1": 3.0, "src2": 0.5}, 1.0


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5 of the parts, as a double in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def cumulative(mean: Column) -> Column:
    """P(X <= k) of a Poisson variable for k = 0, 1, ... until the sum no longer grows or is within 1e-16 of 1."""
    k_max = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("out"))
    grown = F.aggregate(
        F.sequence(F.lit(1), k_max),
        start,
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"),
            (acc["c"] + acc["p"] * mean / k).alias("c"),
            F.concat(acc["out"], F.array(acc["c"] + acc["p"] * mean / k)).alias("out"),
        ),
    )
    return grown["out"]


def rates(docs: DataFrame, weights: dict[str, float], other: float, budget: float | None = None, null_name: str = "(none)") -> DataFrame:
    """(__source, __mean, __parts, __cdf) for each source: one pass over the texts' lengths, summed before the shuffle."""
    named = docs.select(F.coalesce("source", F.lit(null_name)).alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    per = named.groupBy("source").agg(F.sum("n").alias("chars"))
    weight = F.coalesce(*(F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()), F.lit(float(other)))
    per = per.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(F.lit(0.0)))
    total = per.agg(F.sum("weight").alias("weights"), F.sum("chars").alias("all_chars"))
    per = per.crossJoin(F.broadcast(total))  # one row
    goal = F.lit(float(budget)) if budget is not None else F.col("all_chars").cast("double")
    mean = F.when(F.col("weight") > 0, goal * F.col("weight") / F.col("weights") / F.col("chars")).otherwise(F.lit(0.0))
    per = per.select(F.col("source").alias("__source"), mean.alias("__mean"))
    per = per.withColumn("__parts", F.greatest(F.lit(1), F.ceil(F.col("__mean") / PART_MEAN)).cast("int"))
    return per.withColumn("__cdf", cumulative(F.col("__mean") / F.col("__parts")))


def name(doc_id: Column, text: Column) -> Column:
    """What the hashes see of a row: its id and its text, so that rows without an id, or that share one, differ."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))


def copies(key: Column, seed: str = SEED) -> Column:
    """The Poisson count of the row of this name, which has the columns of its source's rate."""

    def draw(i: Column) -> Column:
        u = uniform(F.lit(seed), i.cast("string"), key)
        return F.size(F.filter(F.col("__cdf"), lambda c: c <= u))

    one = draw(F.lit(0))
    many = F.aggregate(F.sequence(F.lit(1), F.col("__parts") - 1), F.lit(0), lambda acc, i: acc + draw(i))
    return F.when(F.col("__mean") <= 0, 0).when(F.col("__parts") > 1, one + many).otherwise(one)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, other: float = OTHER, budget: float | None = None, seed: str = SEED, null_name: str = "(none)") -> DataFrame:
    """All columns of docs, then copy (0, 1, ...) and shuffle_key, for each copy that the target weights ask for, in a
    global random order. budget: characters of the result in the mean; by default those of docs."""
    per = rates(docs, WEIGHTS if weights is None else weights, other, budget, null_name)
    # the documents travel in one column, so that no name of theirs meets one made here
    named = docs.select(F.coalesce("source", F.lit(null_name)).alias("__source"), "doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"))
    if per.count() <= BROADCAST_SOURCES:
        counted = named.join(F.broadcast(per), "__source")
    else:
        salted = per.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        counted = named.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")).join(salted, ["__source", "__salt"])
    n = counted.withColumn("__name", name(F.col("doc_id"), F.col("text"))).withColumn("__n", copies(F.col("__name"), seed)).where("__n > 0")
    each = n.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("__name"), F.col("__copy").cast("string")))
    copy, order = unused(docs, "copy"), unused(docs, "shuffle_key")
    dealt = each.select(*(F.col("__doc")[c].alias(c) for c in docs.columns), F.col("__copy").alias(copy), key.alias(order))
    return dealt.repartition(order).sortWithinPartitions(order)


ORACLE_SQL = f"""
WITH RECURSIVE per AS (
    SELECT coalesce(source, '(none)') AS source, sum(coalesce(length(text), 0)) AS chars FROM documents GROUP BY 1),
weighted AS (
    SELECT source, chars, CASE WHEN chars <= 0 THEN 0.0::DOUBLE {" ".join(f"WHEN source = '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items())} ELSE {OTHER}::DOUBLE END AS weight FROM per),
rates AS (
    SELECT source, CASE WHEN weight > 0 THEN (sum(chars) OVER ())::DOUBLE * weight / sum(weight) OVER () / chars::DOUBLE ELSE 0.0::DOUBLE END AS mean FROM weighted),
cdf AS (
    SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM rates
    UNION ALL
    SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < 200),
tables AS (SELECT source, mean, list(c ORDER BY k) AS cs FROM cdf GROUP BY ALL),
counted AS (
    SELECT d.*, t.mean, len(list_filter(t.cs, lambda c: c <= ('0x' || substr(md5('{SEED}:0:' || coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, ''))), 1, 13))::BIGINT::DOUBLE / {1 << 52}::DOUBLE)) AS n
    FROM documents d JOIN tables t ON t.source = coalesce(d.source, '(none)'))
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(n)) AS copy FROM counted WHERE mean > 0 AND n > 0)"""
