"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.shared import discard, shared_dir  # noqa: F401
from tidemark.functions.shared import stage as stage_path  # noqa: F401
from tidemark.functions.shared import staged as stage_table  # noqa: F401


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with at least one in HOT of all rows is hot: there are HOT hot keys at most, however many rows there are.
HOT = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """left joined with right on key. right has one row a key and n, the number of left's rows with it; left has `rows` rows.
    The few keys of very many rows are joined by a broadcast, so that no task gets a whole one; n is dropped."""
    least = max(2, rows // HOT)
    hot = right.where(F.col("n") >= least).drop("n")
    cold = right.where(F.col("n") < least).drop("n")
    few = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return left.join(F.broadcast(hot), key).unionByName(few)


def fold(key: str, parts: int):
    """crc32 of the key as text, modulo parts; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(parts))


def hashed_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows of df (all, if it has no more), chosen by a hash of the key: the same on every run."""
    total = df.count()
    if total <= rows:
        return df
    limit = int(rows / total * (1 << 31))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 31)) < limit)


#: Bounds of a sample to fit on, besides its rows: code points of all its texts, and of one of them. A longer text is not
#: learned from (it is scored like any other).
TRAIN_CHARS, TRAIN_TEXT = 48_000_000, 1_000_000


def fit_sample(docs: DataFrame, picked: DataFrame, columns: list[str], seed: int = 7, chars: int = TRAIN_CHARS, longest: int = TRAIN_TEXT) -> DataFrame:
    """(doc_id, text, columns) of the picked ids, a table in the shared folder: one row an id (that with the smallest text),
    and, in the order of a hash, as many as have `chars` code points together. picked is (doc_id, ...), one row an id."""
    # at most about as many ids as the sample has rows: a proven bound, so the documents are not shuffled
    known = docs.where(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text", *(c for c in columns if c not in picked.columns))
    rest = F.struct("text", *columns)
    one = known.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(rest).alias("r")).select("doc_id", "r.*")
    one = stage_table(one, "sample")
    order = Window.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")  # the ids of the sample
    fits = one.select("doc_id", F.sum(F.length("text")).over(order).alias("sum")).where(F.col("sum") <= chars).select("doc_id")
    return one.join(F.broadcast(fits), "doc_id", "left_semi")


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, out: int, rows: int, seed: int = 7) -> DataFrame:
    """(doc_id, text, y) for fitting: a bounded sample of the labelled rows outside the held-out fold.

    ``rows`` bounds the sample whatever the size of the tables; null labels, null ids and null texts are left out,
    a doc_id with contradicting labels takes the larger one, and one with several texts the smallest.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold("doc_id", parts) != out))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    return fit_sample(docs, hashed_sample(known, "doc_id", rows, seed), ["y"], seed).select("doc_id", "text", "y")
