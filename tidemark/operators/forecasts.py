"""The newest complete cross-section of forecasts, why newer ones are passed over, and the view of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import AUDITED

from .sectors import exact_days, leaders

#: fixed values: horizons of a forecast, share of the largest market seen so far that a session must have bars of
HORIZONS, FLOOR = (5, 10, 20), 0.9


def coverage(bars: DataFrame, benchmark: str) -> DataFrame:
    """(session, symbols, reference, ratio, benchmark): symbols with an audited bar against the largest number of any session up
    to then, so that a run of partial imports cannot become its own measure."""
    ok = bars.where(F.col("source").isin(*AUDITED) & (F.col("close") > 0))
    per = ok.groupBy("session").agg(F.countDistinct(F.when(F.col("symbol") != benchmark, F.col("symbol"))).alias("symbols"), F.max(F.col("symbol") == benchmark).alias("benchmark"))
    w = Window.orderBy("session").rowsBetween(Window.unboundedPreceding, 0)  # a row a session
    d = per.withColumn("reference", F.max("symbols").over(w))
    return d.withColumn("ratio", F.coalesce(F.try_divide(F.col("symbols"), F.col("reference")), F.lit(0.0)))


def audit(forecasts: DataFrame, bars: DataFrame, benchmark: str, horizons: tuple[int, ...] = HORIZONS, floor: float = FLOOR) -> DataFrame:
    """(session, horizons, plates, models, ratio, reason) of each session that has forecasts (session, plate, horizon, model).
    A cross-section is complete when exactly the wanted horizons are there, each with the same set of plates, all from one
    model, and the session has the benchmark and enough of the market; reason is the first of these that fails, else null.

    The sets of plates are equal when each horizon has as many plates as all have together, so the test is a count by horizon
    and not a comparison of sets."""
    per = forecasts.groupBy("session", "horizon").agg(F.countDistinct("plate").alias("__p"))
    per = per.groupBy("session").agg(F.count("*").alias("horizons"), F.count_if(F.col("horizon").isin(*horizons)).alias("__wanted"), F.min("__p").alias("__least"))
    every = forecasts.groupBy("session").agg(F.countDistinct("plate").alias("plates"), F.countDistinct(F.coalesce("model", F.lit(""))).alias("models"))
    d = per.join(every, "session").join(coverage(bars, benchmark), "session", "left")
    n = len(horizons)
    reason = (
        F.when((F.col("horizons") != n) | (F.col("__wanted") != n), "horizons")
        .when((F.col("plates") == 0) | (F.col("__least") != F.col("plates")), "plates")
        .when(F.col("models") != 1, "models")
        .when(~F.coalesce("benchmark", F.lit(False)), "benchmark")
        .when(F.col("ratio") < floor, "coverage")
    )
    return d.select("session", "horizons", "plates", "models", F.coalesce("ratio", F.lit(0.0)).alias("ratio"), reason.alias("reason"))


def state(audited: DataFrame, bars: DataFrame, benchmark: str, floor: float = FLOOR) -> DataFrame:
    """One row (session, newest, ratio, ignored, stale, warning): the newest complete cross-section, the newest session with a
    benchmark, the newer cross-sections passed over (session:reason, newest first), and whether what is shown is stale. A newer
    session that is complete but has no forecast is an error: the forecast must be made first. So is no complete one at all."""
    best = F.max(F.when(F.col("reason").isNull(), F.col("session")))
    one = audited.agg(best.alias("session"), F.collect_list(F.struct("session", "reason")).alias("__all"))  # a row a session with forecasts
    last = coverage(bars, benchmark).where("benchmark").agg(F.max(F.struct("session", "ratio")).alias("__last"))
    d = one.crossJoin(F.broadcast(last))  # one row each
    newer = F.sort_array(F.filter("__all", lambda x: x["session"] > F.col("session")), asc=False)
    d = d.withColumn("ignored", F.array_join(F.transform(newer, lambda x: F.concat_ws(":", x["session"].cast("string"), x["reason"])), ","))
    newest, full = F.col("__last.session"), F.col("__last.ratio") >= floor
    partial = (newest > F.col("session")) & ~full
    fault = F.when(F.col("session").isNull(), "no forecast cross-section is complete").when(~(partial | ((newest == F.col("session")) & full)), "forecasts lag the newest complete session")
    stale = F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(partial | (F.col("ignored") != ""))
    warning = F.when(partial, "partial market").when(F.col("ignored") != "", "ignored cross-sections")
    return d.select("session", newest.alias("newest"), F.col("__last.ratio").alias("ratio"), "ignored", stale.alias("stale"), warning.alias("warning"))


def view(forecasts: DataFrame, shown: DataFrame, flows: DataFrame, quotes: DataFrame, days: int = 5) -> DataFrame:
    """The rows of the cross-section that state() shows, with each plate's rank by score in its horizon (ties: lower plate), the
    flow of exactly the last `days` sessions up to it (null if one lacks), and its leading member that day (null if too few
    report), and the state."""
    one = F.broadcast(shown)  # one row
    own = forecasts.join(one, "session")
    w = Window.partitionBy("horizon").orderBy(F.desc_nulls_last("score"), "plate")
    own = own.withColumn("rank", F.row_number().over(w))
    until = flows.crossJoin(F.broadcast(shown.select(F.col("session").alias("__at")))).where(F.col("session") <= F.col("__at")).drop("__at")  # one row
    flow = exact_days(until, days).withColumnRenamed("flow", "recent_flow")
    lead = leaders(quotes.join(F.broadcast(shown.select("session")), "session", "left_semi")).select("plate", F.col("symbol").alias("leader"), F.col("change").alias("leader_change"))
    return own.join(flow, "plate", "left").join(lead, "plate", "left")
