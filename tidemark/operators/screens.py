"""The screen with its filters, and tables of scores that are replaced by day behind a gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import finite

from .market import preselect

RISKS = ("low", "mid", "high")


def filtered(
    scored: DataFrame, securities: DataFrame, industries: list[str] | None = None, least_cap: float | None = None, style: str | None = None, risk: str | None = None,
    watchlist: DataFrame | None = None, style_is_current: bool = True,
) -> DataFrame:
    """scored (symbol, session, score, volatility, ...) of listed securities that are not ST, with those filters that are given.
    securities is (symbol, industry, cap, style, listed, is_st). Risk is the third of the session's volatilities, of all scored
    symbols and not of those that are left; a session without any is an error if risk is asked for. A list of industries of
    blanks alone is an error. Rows without a finite score are left out; a style that is not current is shown as null."""
    names = None if industries is None else list(dict.fromkeys(i.strip() for i in industries if i.strip()))
    if names == []:
        raise ValueError("name one industry at least")
    if risk is not None and risk not in RISKS:
        raise ValueError(f"no such risk: {risk}")
    d = scored.withColumn("volatility", finite(F.col("volatility")))
    if risk is not None:
        thirds = d.groupBy("session").agg(F.percentile("volatility", F.lit(1 / 3)).alias("__a"), F.percentile("volatility", F.lit(2 / 3)).alias("__b"))
        checked = F.when(F.col("__a").isNull(), F.raise_error(F.lit("no volatility to tell risks by")).cast("double")).otherwise(F.col("__a"))
        thirds, v = thirds.withColumn("__a", checked), F.col("volatility")
        level = F.when(F.col("__a") >= v, "low").when(v <= F.col("__b"), "mid").when(v > F.col("__b"), "high")
        d = d.join(thirds, "session").withColumn("__risk", level).where(F.col("__risk") == risk).drop("__a", "__b", "__risk")
    s = securities.withColumn("industry", F.trim("industry")).withColumn("cap", finite(F.col("cap"))).where(F.col("listed") & ~F.col("is_st"))
    if names is not None:
        s = s.where(F.col("industry").isin(*names))
    if least_cap is not None:
        s = s.where(F.col("cap") >= least_cap)
    if style is not None:
        s = s.where(F.col("style") == style)
    if watchlist is not None:
        s = s.join(watchlist.select("symbol").distinct(), "symbol", "left_semi")
    shown = F.col("style") if style_is_current else F.lit(None).cast("string")
    d = d.withColumn("score", finite(F.col("score"))).where("score IS NOT NULL")
    return d.join(s.select("symbol", "industry", "cap", shown.alias("style")), "symbol")


def best(rows: DataFrame, n: int, value: str = "expected") -> DataFrame:
    """The n best of each session, in the order of the screen."""
    return preselect(rows, value, "score", ["session"], n)


def gated(rows: DataFrame, column: str, least: float) -> DataFrame:
    """The rows of the sessions in which at least a share of rows has a value; the others are not good enough to replace what is
    there."""
    per = rows.groupBy("session").agg(F.count(column).alias("__n"), F.count("*").alias("__m"))
    return rows.join(per.where(F.col("__n") >= F.lit(least) * F.col("__m")).select("session"), "session", "left_semi")
