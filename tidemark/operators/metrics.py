"""Signal and portfolio metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import average_rank, guarded_corr


def rank_ic(df: DataFrame, score: str, future: str, by: list[str]) -> DataFrame:
    """(by, n, ic): Pearson correlation of the average ranks of complete pairs; null for under two or a constant side."""
    both = df.where(F.col(score).isNotNull() & F.col(future).isNotNull())
    ranked = both.withColumn("__a", average_rank(score, by)).withColumn("__b", average_rank(future, by))
    return guarded_corr(ranked, "__a", "__b", by, "ic")


def ic_summary(ic: DataFrame, by: list[str]) -> DataFrame:
    """n, mean, sample deviation, IR, t and positive share of the non-null values."""
    g = ic.where(F.col("ic").isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.avg((F.col("ic") > 0).cast("double")).alias("positive")
    )
    ir = F.try_divide(F.col("mean"), F.nullif(F.col("std"), F.lit(0.0)))
    return g.withColumn("ir", ir).withColumn("t", F.col("ir") * F.sqrt("n"))


def layers(df: DataFrame, score: str, future: str, by: list[str], groups: int = 10) -> DataFrame:
    """(by, layer, n, ret): mean future by layer of the order (score, symbol): position i of N falls into
    min(groups - 1, i * groups div (N - 1)); one row alone is in the top layer."""
    w = Window.partitionBy(*by)
    d = df.where(F.col(score).isNotNull() & F.col(future).isNotNull())
    d = d.withColumn("__i", F.row_number().over(w.orderBy(score, "symbol")) - 1).withColumn("__n", F.count("*").over(w))
    layer = F.when(F.col("__n") == 1, groups - 1).otherwise(F.least(F.lit(groups - 1), F.floor(F.col("__i") * groups / (F.col("__n") - 1)))).cast("int")
    return d.withColumn("layer", layer).groupBy(*by, "layer").agg(F.count("*").alias("n"), F.avg(future).alias("ret"))


def long_short(layered: DataFrame, by: list[str]) -> DataFrame:
    return layered.groupBy(*by).agg((F.max_by("ret", "layer") - F.min_by("ret", "layer")).alias("spread"))


def nav_performance(nav: DataFrame, by: list[str], year: int = 252) -> DataFrame:
    """total, annual, volatility, sharpe, drawdown and calmar of a NAV series (session, nav); series with a value that is
    not positive are left out. A flat series has no volatility."""
    w = Window.partitionBy(*by).orderBy("session")
    d = nav.withColumn("__r", F.try_divide(F.col("nav"), F.lag("nav").over(w)) - 1)
    d = d.withColumn("__dd", F.try_divide(F.col("nav"), F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1)
    g = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("nav").alias("__low"), F.min_by("nav", "session").alias("__a"), F.max_by("nav", "session").alias("__b"),
        F.stddev_samp("__r").alias("__sd"), F.avg("__r").alias("__m"), F.min("__dd").alias("drawdown"),
    ).where("__low > 0")
    g = g.withColumn("total", F.try_divide(F.col("__b"), F.col("__a")) - 1)
    g = g.withColumn("annual", F.when(F.col("n") > 1, F.pow(1 + F.col("total"), F.lit(float(year)) / (F.col("n") - 1)) - 1))
    g = g.withColumn("volatility", F.nullif(F.col("__sd"), F.lit(0.0)) * F.sqrt(F.lit(float(year))))
    g = g.withColumn("sharpe", F.try_divide(F.col("__m") * year, F.nullif(F.col("volatility"), F.lit(0.0))))
    return g.withColumn("calmar", F.try_divide(F.col("annual"), F.nullif(F.abs("drawdown"), F.lit(0.0)))).drop("__low", "__a", "__b", "__sd", "__m")


def effective_window(daily: DataFrame) -> DataFrame:
    """The rows (run, session, turnover, ...) of each run from the session before its first trade; all of a run without any."""
    w = Window.partitionBy("run").orderBy("session")
    d = daily.withColumn("__i", F.row_number().over(w))
    first = F.min(F.when(F.col("turnover") > 0, F.col("__i"))).over(Window.partitionBy("run"))
    return d.withColumn("__first", first).where(F.coalesce(F.col("__i") >= F.col("__first") - 1, F.lit(True))).drop("__i", "__first")


def turnover_stats(df: DataFrame, turnover: str, by: list[str], year: int = 252) -> DataFrame:
    """n, total, mean, median, max of the non-null turnovers; annual is the total scaled from all rows to a year."""
    g = df.groupBy(*by).agg(
        F.count("*").alias("__rows"), F.count(turnover).alias("n"), F.sum(turnover).alias("total"), F.avg(turnover).alias("mean"), F.median(turnover).alias("median"), F.max(turnover).alias("max")
    )
    return g.withColumn("annual", F.col("total") * year / F.col("__rows")).drop("__rows")


def calibration(df: DataFrame, p: str, hit: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate, brier): every fixed-width bin has a row; brier is over all rows."""
    d = df.where(F.col(p).isNotNull() & F.col(hit).isNotNull())
    b = d.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int"))
    g = b.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(hit).cast("double")).alias("rate"))
    brier = d.agg(F.avg(F.pow(F.col(p) - F.col(hit).cast("double"), F.lit(2.0))).alias("brier"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(g, "bin", "left").crossJoin(F.broadcast(brier)).withColumn("n", F.coalesce("n", F.lit(0)))


def decision_sessions(df: DataFrame, every: int) -> DataFrame:
    """The distinct sessions of df, every `every`-th from the first."""
    days = df.select("session").distinct().withColumn("__i", F.row_number().over(Window.orderBy("session")) - 1)  # the list of sessions
    return days.where(F.col("__i") % every == 0).select("session")


def factor_correlation(wide: DataFrame, factors: list[str], every: int = 20, least_rows: int = 3, least_days: int = 3, flat: float = 1e-12) -> DataFrame:
    """(left, right, days, corr): mean over the decision sessions (every `every`-th) of the cross-sectional correlation of each
    pair of factors. wide is (session, z_<factor>...); all pairs come from one aggregate of sums by session, no join."""
    d = wide.join(F.broadcast(decision_sessions(wide, every)), "session", "left_semi")
    pairs = [(a, b) for a in sorted(factors) for b in sorted(factors) if a <= b]

    def sums(a: str, b: str):
        x, y = F.col(f"z_{a}"), F.col(f"z_{b}")
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        return F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.count(x).alias("n"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.covar_pop(x, y).alias("c"))

    daily = d.groupBy("session").agg(F.array(*(sums(a, b) for a, b in pairs)).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    ok = (F.col("n") >= least_rows) & (F.col("sx") > flat) & (F.col("sy") > flat)
    daily = daily.where(ok).withColumn("corr", F.try_divide(F.col("c"), F.col("sx") * F.col("sy")))
    return daily.groupBy("left", "right").agg(F.count("*").alias("days"), F.avg("corr").alias("corr")).where(F.col("days") >= least_days)


def forward_returns(px: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(symbol, session, horizon, future): a row for each horizon."""
    w = Window.partitionBy("symbol").orderBy("session")
    wide = px.select("symbol", "session", *((F.try_divide(F.lead("px", h).over(w), F.col("px")) - 1).alias(f"h{h}") for h in horizons))
    stacked = ", ".join(f"{h}, h{h}" for h in horizons)
    return wide.select("symbol", "session", F.expr(f"stack({len(horizons)}, {stacked}) as (horizon, future)"))


def ir_weights(stats: DataFrame, ok: Column) -> DataFrame:
    """weight = IR / sum of absolute IRs over the factors that are ok; others 0."""
    w = Window.partitionBy()
    used = F.when(ok & F.col("ir").isNotNull(), F.col("ir")).otherwise(0.0)
    return stats.withColumn("__u", used).withColumn("weight", F.coalesce(F.try_divide(F.col("__u"), F.sum(F.abs("__u")).over(w)), F.lit(0.0))).drop("__u")
