"""Bars that are read through: a provider's own first, then what audited rows of the cache give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import AUDITED

PRICES = ("open", "high", "low", "close")


def period(session: Column, frequency: str) -> Column:
    """The period of a day: the Friday that ends its week (Saturday begins one), or its month's first day."""
    if frequency == "w":
        return F.date_add(session, F.pmod(F.lit(6) - F.dayofweek(session), F.lit(7)))
    if frequency == "m":
        return F.trunc(session, "month")
    raise ValueError(f"no such frequency: {frequency}")


def resampled(daily: DataFrame, frequency: str) -> DataFrame:
    """Bars of weeks or months from the days that have all prices: named by their last day, and only where there is one."""
    ok = daily.where(F.col("session").isNotNull())
    for p in PRICES:
        ok = ok.where(F.col(p).isNotNull() & ~F.isnan(p))
    g = ok.groupBy("symbol", period(F.col("session"), frequency).alias("__p")).agg(
        F.max("session").alias("session"), F.min_by("open", "session").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "session").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"),
    )
    return g.drop("__p")


def origins(wanted: DataFrame, daily: DataFrame, native: DataFrame, cache: DataFrame) -> DataFrame:
    """(symbol, frequency, origin, sources) for each wanted (symbol, frequency). A whole symbol and frequency comes from one
    place: native bars of weeks and months before those made of the provider's days, these before the cache's; a provider that
    has a symbol is not filled up from the cache. The cache counts only if all its rows of the symbol are audited: one that is
    not refuses it."""
    has_daily = daily.select("symbol").distinct().withColumn("__daily", F.lit(True))
    has_native = native.select("symbol", "frequency").distinct().withColumn("__native", F.lit(True))
    per = cache.groupBy("symbol").agg(
        F.bool_and(F.coalesce(F.col("source").isin(*AUDITED), F.lit(False))).alias("__clean"), F.array_join(F.sort_array(F.collect_set("source")), "+").alias("__sources")
    )  # sources are a short list
    d = wanted.join(has_native, ["symbol", "frequency"], "left").join(has_daily, "symbol", "left").join(per, "symbol", "left")
    day = F.col("frequency") == "d"
    origin = (
        F.when(F.col("__native") & ~day, "native")
        .when(F.col("__daily"), F.when(day, "provider").otherwise("provider_resampled"))
        .when(F.col("__clean"), F.when(day, "cache").otherwise("cache_resampled"))
        .when(F.col("__clean").isNotNull(), "refused")
        .otherwise("missing")
    )
    d = d.withColumn("origin", origin)
    return d.select("symbol", "frequency", "origin", F.when(F.col("origin").startswith("cache"), F.col("__sources")).alias("sources"))


def read_through(wanted: DataFrame, daily: DataFrame, native: DataFrame, cache: DataFrame) -> DataFrame:
    """The bars of all wanted (symbol, frequency), with origin and sources; none for what is refused or missing. daily and cache
    are bars of days, native bars with a frequency, cache with a source. The cache stays one of days: nothing is written."""
    o = origins(wanted, daily, native, cache)
    columns = ["symbol", "session", *PRICES, "volume", "amount"]

    def of(rows: DataFrame, origin: str, frequency: str) -> DataFrame:
        own = o.where((F.col("origin") == origin) & (F.col("frequency") == frequency))
        return rows.select(*columns).join(own, "symbol")

    parts = [of(daily, "provider", "d"), of(cache, "cache", "d")]
    for f in ("w", "m"):
        parts.append(of(native.where(F.col("frequency") == f), "native", f))
        for rows, origin in ((daily, "provider_resampled"), (cache, "cache_resampled")):
            # only the symbols that need it are made into periods
            own = o.where((F.col("origin") == origin) & (F.col("frequency") == f)).select("symbol")
            parts.append(of(resampled(rows.join(own, "symbol", "left_semi"), f), origin, f))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("symbol", "frequency", "session", *PRICES, "volume", "amount", "origin", "sources")
