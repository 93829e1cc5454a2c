"""Cross-sectional factors, composite and multi-dimension scores, technical features and rule forecasts.

All operators take long frames keyed by (symbol, session) and score every session in one plan: windows are partitioned by
symbol for histories and by session for cross-sections, so nothing loops over days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import average_rank, clip, full, percent_rank_avg, scaled_rank, sigmoid, winsor_zscores


def adjusted(bars: DataFrame, adj: DataFrame) -> DataFrame:
    """bars with px (close times factor) and degraded: a missing factor counts as 1 and is flagged."""
    j = bars.join(adj, ["symbol", "session"], "left")
    return j.withColumn("degraded", F.col("adj_factor").isNull()).withColumn("px", F.col("close") * F.coalesce("adj_factor", F.lit(1.0))).drop("adj_factor")


def calendar(bars: DataFrame) -> DataFrame:
    """(session, ord): the distinct sessions, numbered from 1. The list of sessions is short whatever the number of rows."""
    return bars.select("session").distinct().withColumn("ord", F.row_number().over(Window.orderBy("session")))


def densify(bars: DataFrame) -> DataFrame:
    """A row for each symbol and calendar session; sessions without a bar have null values."""
    days = bars.select("session").distinct().agg(F.array_sort(F.collect_list("session")).alias("days"))
    grid = bars.select("symbol").distinct().crossJoin(F.broadcast(days)).select("symbol", F.posexplode("days").alias("pos", "session"))
    return grid.withColumn("ord", F.col("pos") + 1).drop("pos").join(bars, ["symbol", "session"], "left")


def price_factors(bars: DataFrame, adj: DataFrame, short: int = 20, long: int = 60) -> DataFrame:
    """momentum over `short` and `long` sessions and volatility on forward-filled adjusted closes, and the change of the mean
    amount of 5 sessions, where absent bars count 0. Null until the history is complete."""
    d = densify(adjusted(bars, adj))
    w = Window.partitionBy("symbol").orderBy("ord")
    d = d.withColumn("px", F.last("px", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("flow", F.coalesce("amount", "volume", F.lit(0.0)))
    d = d.withColumn("ret", F.try_divide(F.col("px"), F.lag("px").over(w)) - 1)
    year = w.rowsBetween(-(short - 1), 0)
    now, before = F.avg("flow").over(w.rowsBetween(-4, 0)), F.avg("flow").over(w.rowsBetween(-9, -5))
    return d.select(
        "symbol",
        "session",
        (F.try_divide(F.col("px"), F.lag("px", short).over(w)) - 1).alias("momentum_short"),
        (F.try_divide(F.col("px"), F.lag("px", long).over(w)) - 1).alias("momentum_long"),
        (full(F.stddev_pop("ret"), "ret", year, short) * F.sqrt(F.lit(252.0))).alias("volatility"),
        F.when(F.lag("px", 10).over(w).isNotNull(), F.try_divide(now, before) - 1).alias("turnover_change"),
    )


def daily_returns(bars: DataFrame, adj: DataFrame) -> DataFrame:
    """Adjusted close over the symbol's previous bar less 1, without filling."""
    w = Window.partitionBy("symbol").orderBy("session")
    return adjusted(bars, adj).select("symbol", "session", (F.try_divide(F.col("px"), F.lag("px").over(w)) - 1).alias("ret"))


def standardise(df: DataFrame, factors: list[str], by: list[str]) -> DataFrame:
    """A column z_<factor> for each factor: winsorised z-score of the cross-section."""
    return winsor_zscores(df, {f: f"z_{f}" for f in factors}, by)


def composite(df: DataFrame, weights: dict[str, float], by: list[str], out: str = "score") -> DataFrame:
    """Weighted mean of z-scores over the factors that are active that day (non-zero weight and any value), missing z
    counting 0, scaled to 0..100 by average rank. Means are compared to nine places, so that rounding makes no order."""
    w = Window.partitionBy(*by)
    used = {f: v for f, v in weights.items() if v}
    total = sum((F.coalesce(f"z_{f}", F.lit(0.0)) * v for f, v in used.items()), F.lit(0.0))
    size = sum((F.when(F.count(f"z_{f}").over(w) > 0, abs(v)).otherwise(0.0) for f, v in used.items()), F.lit(0.0))
    return df.withColumn("raw", F.round(F.try_divide(total, size), 9)).withColumn(out, scaled_rank("raw", by))


def valuation_ranks(df: DataFrame, ratio: str, by: list[str], out: str) -> DataFrame:
    """Average-rank percentile over the positive ratios only; others are null."""
    positive = df.withColumn("__p", F.when(F.col(ratio) > 0, F.col(ratio)))
    return positive.withColumn(out, percent_rank_avg("__p", by)).drop("__p")


def five_dimensions(df: DataFrame) -> DataFrame:
    """Five scores of 0..10 from z-scores and their weighted sum. Columns z_<factor>. A missing z counts 0 and keeps its place
    in the mean of its dimension, so that all rows share the divisors."""

    def mean(*names: str) -> Column:
        return sum((F.coalesce(n, F.lit(0.0)) for n in names), F.lit(0.0)) / len(names)

    def score(z: Column) -> Column:
        return clip(5 + 2 * F.coalesce(z, F.lit(0.0)), 0.0, 10.0)

    # fixed values: the weights of the five dimensions
    dims = {
        "technical": (score(mean("z_momentum_short", "z_momentum_long")), 0.25),
        "capital": (score(F.col("z_net_inflow")), 0.20),
        "fundamental": (score(mean("z_roe", "z_profit")), 0.25),
        "valuation": (score(-F.col("z_pe")), 0.15),
        "sentiment": (score(F.col("z_turnover_change")), 0.15),
    }
    out = df.withColumns({k: c for k, (c, _) in dims.items()})
    return out.withColumn("five_dim", sum((F.col(k) * v for k, (_, v) in dims.items()), F.lit(0.0)))


def target_portfolio(df: DataFrame, score: str, by: list[str], share: float) -> DataFrame:
    """The ceil(n * share) best rows of each cross-section; ties go to the lower symbol."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w.orderBy(F.desc(score), "symbol"))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("rank") <= F.ceil(F.col("n") * share)).drop("n")


def technical(bars: DataFrame, least: int = 30) -> DataFrame:
    """Eleven features of each symbol's raw row order; sessions with fewer than `least` bars so far are left out. Missing
    or non-finite features are 0, the volume ratio 1."""
    w = Window.partitionBy("symbol").orderBy("session")

    def back(n: int):
        return w.rowsBetween(-(n - 1), 0)

    d = bars.withColumn("bar", F.row_number().over(w)).withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    d = d.withColumn("vol_ok", F.when(F.col("volume") != 0, F.col("volume")))

    def mom(n: int) -> Column:
        return F.try_divide(F.col("close"), F.lag("close", n).over(w)) - 1

    hi, lo = F.max("close").over(back(60)), F.min("close").over(back(60))
    mean = {n: F.avg("close").over(back(n)) for n in (5, 20, 60)}
    columns = ["open", "high", "low", "close", "volume", "amount"]
    missing = sum((F.sum(F.col(c).isNull().cast("int")).over(w) for c in columns), F.lit(0))
    feats = {
        "mom_1": mom(1), "mom_5": mom(5), "mom_20": mom(20), "mom_60": mom(60),
        "gap_5_20": F.try_divide(mean[5], mean[20]) - 1, "gap_20_60": F.try_divide(mean[20], mean[60]) - 1,
        "vol_20": F.stddev_pop("ret").over(back(20)) * F.sqrt(F.lit(252.0)),
        "drawdown": F.try_divide(F.col("close"), hi) - 1,
        "position": F.when(hi > lo, (F.col("close") - lo) / (hi - lo)).otherwise(0.5),
        "completeness": 1 - missing / (F.col("bar") * len(columns)),
    }
    d = d.withColumns({k: F.coalesce(c, F.lit(0.0)) for k, c in feats.items()})
    d = d.withColumn("volume_ratio", F.coalesce(F.try_divide(F.avg("vol_ok").over(back(5)), F.avg("vol_ok").over(back(20))), F.lit(1.0)))
    return d.where(F.col("bar") >= least).select("symbol", "session", "bar", *feats, "volume_ratio")


def forecasts(tech: DataFrame, horizons=(1, 5, 20)) -> DataFrame:
    """(…, horizon, p_up, expected, q10, q50, q90, confidence, warning): rule forecasts from technical features."""
    h = F.explode(F.array(*(F.lit(x) for x in horizons)))
    d = tech.withColumn("horizon", h)
    root = F.sqrt(F.col("horizon") / 20)
    # fixed values: coefficients of the rule forecast
    z = (
        4 * F.col("mom_20") * F.least(F.lit(1.0), root) + 2 * F.col("mom_5") + 2.5 * F.col("gap_5_20") + 1.5 * F.col("gap_20_60")
        + 0.35 * (F.col("volume_ratio") - 1) + 0.8 * (F.col("position") - 0.5) - 0.55 * F.col("vol_20") + 0.5 * F.col("drawdown")
    )
    scale = F.sqrt(F.col("horizon") / 252.0)
    expected = clip(0.32 * F.col("mom_20") * root + 0.10 * F.col("mom_5") + 0.12 * F.col("gap_5_20") - 0.03 * F.col("vol_20") * scale, -0.35, 0.35)
    d = d.withColumn("p_up", clip(sigmoid(z), 0.05, 0.95)).withColumn("expected", expected)
    sd = F.greatest(F.lit(0.005), F.col("vol_20") * scale)
    conf = clip(0.35 + 0.65 * F.abs(F.col("p_up") - 0.5) + 0.20 * F.col("completeness") - 0.15 * F.least("vol_20", F.lit(1.0)), 0.2, 0.82)
    return d.withColumns(
        {"q10": F.col("expected") - 1.2816 * sd, "q50": F.col("expected"), "q90": F.col("expected") + 1.2816 * sd, "confidence": conf, "warning": F.col("bar") < 120}
    )


def regime(tech: DataFrame) -> DataFrame:
    """The first of six rules that holds, and its confidence."""
    r1, m20, m60, vol, dd, pos = (F.col(c) for c in ("mom_1", "mom_20", "mom_60", "vol_20", "drawdown", "position"))
    # fixed values: thresholds of the rules, in order
    rules = [
        ("EVENT_SHOCK", (vol > 0.50) & (F.abs(r1) > 0.035), F.least(F.lit(0.9), 0.55 + 0.3 * vol)),
        ("TREND_UP", (m20 > 0.05) & (m60 > 0.08) & (dd > -0.06), 0.55 + F.least(F.lit(0.3), 0.8 * (m20 + m60))),
        ("TREND_DOWN", (m20 < -0.05) & (m60 < -0.08), 0.55 + F.least(F.lit(0.3), 0.8 * F.abs(m20 + m60))),
        ("RISK_ON", (m20 > 0.02) & (pos > 0.65), F.lit(0.58)),
        ("RISK_OFF", (dd < -0.12) | (vol > 0.42), F.lit(0.62)),
        ("RANGE", F.lit(True), 0.52 + F.least(F.lit(0.15), 2 * F.abs(m20))),
    ]
    name = F.coalesce(*(F.when(c, k) for k, c, _ in rules))
    conf = F.coalesce(*(F.when(c, v) for _, c, v in rules))
    return tech.withColumn("regime", name).withColumn("regime_confidence", conf)


def alerts(wide: DataFrame) -> DataFrame:
    """Action and position change from p5, p20 and conf20: the first rule that holds."""
    p5, p20, conf = F.col("p5"), F.col("p20"), F.col("conf20")
    action = (
        F.when((p20 >= 0.68) & (p5 >= 0.60) & (conf >= 0.55), "BUY_CANDIDATE").when((p20 <= 0.35) | (p5 <= 0.38), "REDUCE")
        .when(conf < 0.35, "REVIEW_REQUIRED").when(p20 >= 0.56, "WATCH").otherwise("HOLD")
    )
    a = wide.withColumn("action", action)
    change = F.when(F.col("action") == "BUY_CANDIDATE", 0.10).when(F.col("action") == "REDUCE", -0.25).otherwise(0.0)
    return a.withColumn("position_change", change)


def screen_score(p20: Column, vol: Column) -> Column:
    """60 % trend, 25 % low risk, 15 % a constant 50; parts are clipped to 0..100."""
    return 0.60 * clip(50 + (p20 - 0.5) * 150, 0.0, 100.0) + 0.25 * clip(100 - 110 * vol, 0.0, 100.0) + 0.15 * 50


def decile(score: Column) -> Column:
    return F.least(F.floor(score / 10) + 1, F.lit(10)).cast("int")


def rank_column(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    return df.withColumn(out, average_rank(value, by))
