"""Data health: coverage, duplicates, invalid rows, orphans, depth, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bar_audit(bars: DataFrame) -> DataFrame:
    """One row: counts, distinct symbols and sessions, extent, invalid prices, inconsistent highs and lows, weekend rows."""
    bad = (F.col("open") <= 0) | (F.col("high") <= 0) | (F.col("low") <= 0) | (F.col("close") <= 0)
    crossed = (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close"))
    return bars.agg(
        F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"), F.countDistinct("session").alias("sessions"), F.min("session").alias("first"), F.max("session").alias("last"),
        F.count_if(bad).alias("invalid"), F.count_if(crossed).alias("crossed"), F.count_if(F.weekday("session") >= 5).alias("weekend"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, and which side."""
    a, b = left.select(*keys), right.select(*keys)
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def sparse_sessions(bars: DataFrame, share: float) -> DataFrame:
    """Sessions with less than a share of the median number of symbols."""
    per = bars.groupBy("session").agg(F.countDistinct("symbol").alias("symbols"))
    mid = per.agg(F.median("symbols").alias("mid"))
    return per.crossJoin(F.broadcast(mid)).where(F.col("symbols") < F.col("mid") * share).select("session", "symbols")  # mid is one row


def depth_buckets(bars: DataFrame) -> DataFrame:
    """(bucket, symbols): symbols by their number of sessions, in tens up to 40+; empty buckets have 0."""
    n = bars.groupBy("symbol").agg(F.countDistinct("session").alias("n"))
    b = F.least(F.floor(F.col("n") / 10), F.lit(4)).cast("int")
    g = n.groupBy(b.alias("b")).agg(F.count("*").alias("symbols"))
    name = F.when(F.col("b") == 4, "40+").otherwise(F.concat((F.col("b") * 10).cast("string"), F.lit("-"), (F.col("b") * 10 + 9).cast("string")))
    every = bars.sparkSession.range(5).select(F.col("id").cast("int").alias("b"))
    return every.join(g, "b", "left").select(name.alias("bucket"), F.coalesce("symbols", F.lit(0)).alias("symbols"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, digest): independent of the order of rows; a sum, so it is combined before the shuffle. Equal tables agree. The
    sum of the rows' 48 bits is taken in decimals and reduced to 60 bits, so it holds for any number of rows."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))), 1, 12), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row.cast("decimal(20,0)")) % F.lit(2**60), F.lit(0)).cast("long").alias("digest"))


def period_depth(facts: DataFrame, wanted: int) -> DataFrame:
    """(symbol, quarters, years, latest, deep): observed non-null quarters of each symbol against the wanted number."""
    g = facts.where(F.col("value").isNotNull()).groupBy("symbol").agg(
        F.countDistinct("period").alias("quarters"), F.countDistinct(F.substring("period", 1, 4)).alias("years"), F.max("period").alias("latest")
    )
    return g.withColumn("deep", F.col("quarters") >= wanted)


def probe_dates(sessions: DataFrame, warm_up: int) -> DataFrame:
    """First, middle and last session after the warm-up."""
    w = Window.orderBy("session")  # the list of sessions
    d = sessions.withColumn("i", F.row_number().over(w) - warm_up).where("i > 0")
    n = F.max("i").over(Window.partitionBy())
    return d.withColumn("n", n).where((F.col("i") == 1) | (F.col("i") == F.floor(F.col("n") / 2) + 1) | (F.col("i") == F.col("n"))).select("session", "i")
