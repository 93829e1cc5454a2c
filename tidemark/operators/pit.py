"""Point-in-time joins and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import visible


def latest_period(facts: DataFrame, at: Column) -> DataFrame:
    """(symbol, metric, period, value): the newest non-null period known at the instant; one aggregate, no self join."""
    known = visible(facts, "available", at).where(F.col("value").isNotNull())
    return known.groupBy("symbol", "metric").agg(F.max("period").alias("period"), F.max_by("value", "period").alias("value"))


def year_on_year(facts: DataFrame) -> DataFrame:
    """facts with yoy: change on the same quarter of the year before, over its absolute value; null without one."""
    q = F.substring("period", 1, 4).cast("int") * 4 + F.substring("period", 6, 1).cast("int")
    now = facts.withColumn("__q", q)
    before = now.select("symbol", (F.col("__q") + 4).alias("__q"), F.col("value").alias("__before"))
    j = now.join(before, ["symbol", "__q"], "left")
    return j.withColumn("yoy", F.try_divide(F.col("value") - F.col("__before"), F.abs("__before"))).drop("__q", "__before")


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], at: str, since: str, value: str) -> DataFrame:
    """left with the value of the last right row whose time is not after left's: one shuffle by key over the union of both
    sides, the last value carried forward; no pairs are made. Equal times match."""
    names = left.columns
    rows = left.select(*names, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    marks = right.select(*(F.col(n) if n in by else F.lit(None).cast(left.schema[n].dataType).alias(n) for n in names), F.col(since).cast(left.schema[at].dataType).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.union(marks).withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select(*names, value)


def nearest(left: DataFrame, right: DataFrame, on: list[str], at: str, tolerance: int) -> DataFrame:
    """Each left row with the right row of the same keys nearest in time, within the tolerance in seconds: times are put
    into buckets of the tolerance's width, and right rows into the buckets beside theirs as well, so that a left row finds
    the right rows before and after it in its own bucket. One shuffle over both sides, and no pairs are made. Ties go to the
    earlier right row. Columns of right get the suffix _near; unmatched rows have nulls."""
    sec = F.unix_seconds(F.col(at).cast("timestamp"))
    names = [c for c in right.columns if c not in on]
    r = right.dropna(subset=[*on, at]).select(*on, F.struct(*(F.col(c).alias(f"{c}_near") for c in names)).alias("__r"), sec.alias("__s"), F.lit(0).alias("__side"))
    r = r.withColumn("__b", F.explode(F.array(*(F.floor(F.col("__s") / tolerance) + i for i in (-1, 0, 1)))))
    rows = left.withColumns({"__s": sec, "__side": F.lit(1), "__b": F.floor(sec / tolerance)}).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*on, "__b")
    found = F.last(F.when(F.col("__side") == 0, F.struct("__s", "__r")), ignorenulls=True)
    start = Window.unboundedPreceding
    rows = rows.withColumn("__before", found.over(w.orderBy("__s", "__side").rowsBetween(start, 0)))
    rows = rows.withColumn("__after", found.over(w.orderBy(F.desc("__s"), "__side").rowsBetween(start, 0))).where("__side = 1")
    back, ahead = F.col("__s") - F.col("__before.__s"), F.col("__after.__s") - F.col("__s")
    near = F.when((back <= tolerance) & ((back <= ahead) | ahead.isNull()), F.col("__before.__r")).when(ahead <= tolerance, F.col("__after.__r"))
    return rows.withColumn("__near", near).select(*left.columns, *(F.col(f"__near.{c}_near") for c in names))


def resample(bars: DataFrame, period: Column, name: str) -> DataFrame:
    """First open, highest high, lowest low, last close, summed volume and amount, last session by period; bars with a
    missing price are left out."""
    ok = bars.dropna(subset=["open", "high", "low", "close"]).withColumn(name, period)
    return ok.groupBy("symbol", name).agg(
        F.max("session").alias("session"), F.min_by("open", "session").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "session").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"),
    )
