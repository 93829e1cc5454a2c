"""Ranks, standard scores and guarded statistics.

Missing stays missing: null (and non-finite, see clean.finite) inputs give null outputs and never count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1 with ties sharing their mean rank; null for null values, which sort last and so shift nobody."""
    order = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    ties = Window.partitionBy(*by, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(order) + (F.count(value).over(ties) - 1) / 2)


def percent_rank_avg(value: str, by: list[str]) -> Column:
    """Average rank over the number of values: in (0, 1]."""
    return average_rank(value, by) / F.count(value).over(Window.partitionBy(*by))


def scaled_rank(value: str, by: list[str]) -> Column:
    """(average rank - 1) / (n - 1) * 100; a single value, or all values equal, is 50."""
    w = Window.partitionBy(*by)
    n, flat = F.count(value).over(w), F.min(value).over(w) == F.max(value).over(w)
    return F.when(F.col(value).isNull(), None).when((n <= 1) | flat, 50.0).otherwise((average_rank(value, by) - 1) / (n - 1) * 100)


def zscore(value: str, by: list[str], flat: float = 1e-8) -> Column:
    """Population standard score in a cross-section; 0 where the deviation is (nearly) zero."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    return F.when(F.col(value).isNull(), None).when(sd <= flat, 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / sd)


def winsor_zscores(df: DataFrame, outs: dict[str, str], by: list[str], tail: float = 0.025) -> DataFrame:
    """A column for each value column in outs: the value clipped at the linear tail quantiles of its cross-section, then
    its population z-score. All values share one window, so df is read and shuffled once however many there are."""
    w = Window.partitionBy(*by)
    d = df.withColumns({f"__q_{v}": F.percentile(v, [tail, 1 - tail]).over(w) for v in outs})
    clipped = {f"__c_{v}": F.when(F.col(v).isNotNull(), F.least(F.greatest(F.col(v), F.col(f"__q_{v}")[0]), F.col(f"__q_{v}")[1])) for v in outs}
    d = d.withColumns(clipped).drop(*(f"__q_{v}" for v in outs))
    return d.withColumns({out: zscore(f"__c_{v}", by) for v, out in outs.items()}).drop(*clipped)


def winsor_zscore(df: DataFrame, value: str, by: list[str], out: str, tail: float = 0.025) -> DataFrame:
    """winsor_zscores of one value."""
    return winsor_zscores(df, {value: out}, by, tail)


def guarded_corr(df: DataFrame, x: str, y: str, by: list[str], out: str, least: int = 2, flat: float = 1e-12) -> DataFrame:
    """Pearson correlation of complete pairs by group; null with fewer than `least` pairs or a constant side. One
    aggregate of sums, so a hot group is combined before the shuffle."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = both.groupBy(*by).agg(
        F.count("*").alias("n"), F.stddev_pop(x).alias("__sx"), F.stddev_pop(y).alias("__sy"), F.covar_pop(x, y).alias("__c")
    )
    ok = (F.col("n") >= least) & (F.col("__sx") > flat) & (F.col("__sy") > flat)
    return sums.select(*by, "n", F.when(ok, F.try_divide(F.col("__c"), F.col("__sx") * F.col("__sy"))).alias(out))


def full(agg: Column, of: str, w, n: int) -> Column:
    """The aggregate over a frame, null until the frame holds n non-null values."""
    return F.when(F.count(of).over(w) == n, agg.over(w))


def clip(x: Column, lo: float, hi: float) -> Column:
    """Between lo and hi; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -20.0, 20.0)))
