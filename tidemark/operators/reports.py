"""Report views: moving averages, movers, sector calls, grids, availability, calendars, seeks, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clean


def moving_averages(bars: DataFrame, spans=(5, 20, 60), value: str = "close") -> DataFrame:
    """bars with ma<k>: the mean of the last k rows of a symbol, null until there are k values."""
    w = Window.partitionBy("symbol").orderBy("session")
    full = {f"ma{k}": F.when(F.count(value).over(w.rowsBetween(1 - k, 0)) == k, F.avg(value).over(w.rowsBetween(1 - k, 0))) for k in spans}
    return bars.withColumns(full)


def changes(bars: DataFrame, value: str = "close") -> DataFrame:
    """bars with change: value over the symbol's previous value, less one; null on its first row."""
    before = F.lag(value).over(Window.partitionBy("symbol").orderBy("session"))
    return bars.withColumn("change", F.try_divide(F.col(value), F.nullif(before, F.lit(0.0))) - 1)


def movers(changed: DataFrame, n: int = 5) -> DataFrame:
    """(session, side, rank, symbol, change): the n largest gains and the n largest losses of each session."""
    known = changed.where("change is not null").select("session", "symbol", "change")

    def side(name: str, order: Column) -> DataFrame:
        w = Window.partitionBy("session").orderBy(order, "symbol")
        return known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("side", F.lit(name))

    return side("gain", F.desc("change")).unionByName(side("loss", F.asc("change")))


def plate_changes(changed: DataFrame, plates: DataFrame) -> DataFrame:
    """(plate, session, change, members): the mean change of a plate's members that have one."""
    return changed.join(plates, "symbol").groupBy("plate", "session").agg(F.avg("change").alias("change"), F.count("change").alias("members")).where("members > 0")


def top_fifth(scores: DataFrame) -> DataFrame:
    """The best fifth of each session's plates, one at least: change descending, then plate; with rank."""
    day = Window.partitionBy("session")
    ranked = scores.withColumn("rank", F.row_number().over(day.orderBy(F.desc("change"), "plate"))).withColumn("n", F.count("*").over(day))
    return ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.floor((F.col("n") + 4) / 5))).drop("n")


def call_excess(scores: DataFrame, calls: int = 3) -> DataFrame:
    """(session, calls, excess): the mean next change of a session's best plates over the median of all plates."""
    nxt = scores.withColumn("next", F.lead("change").over(Window.partitionBy("plate").orderBy("session")))
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("change"), "plate"))
    called = F.when((F.col("rank") <= calls) & F.col("next").isNotNull(), F.col("next"))
    per = nxt.withColumn("rank", rank).groupBy("session").agg(F.count(called).alias("calls"), (F.avg(called) - F.median("next")).alias("excess"))
    return per.where("calls > 0")


def count_grid(events: DataFrame, day: str, state: str) -> DataFrame:
    """(day, state, n) for every pair of a day and a state that occur at all; 0 where they do not occur together.

    The grid is that of the distinct values on each side: a calendar and a list of states.
    """
    n = events.groupBy(day, state).agg(F.count("*").alias("n"))
    grid = n.select(day).distinct().crossJoin(F.broadcast(n.select(state).distinct()))
    return grid.join(n, [day, state], "left").select(day, state, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def availability(published: Column, period_end: Column) -> tuple[Column, Column]:
    """(available, approximate): local midnight after the day of publication as UTC; 45 days after the period's end, as
    an approximation, where that day is unknown."""
    day = F.coalesce(F.date_add(published, 1), F.date_add(period_end, 45))
    return F.to_utc_timestamp(day.cast("timestamp"), clean.ZONE).cast("timestamp_ntz"), published.isNull()


def first_filled(*columns: Column) -> Column:
    """The first of the columns that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def split_calendar(sessions: DataFrame, tenths: int = 7) -> DataFrame:
    """Distinct sessions with part: train for the first tenths of them, rounded down, then test."""
    days = sessions.select("session").distinct()
    numbered = days.withColumn("i", F.row_number().over(Window.orderBy("session"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    return numbered.select("session", F.when(F.col("i") <= F.floor(F.col("n") * tenths / 10), "train").otherwise("test").alias("part"))


def first_at_least(df: DataFrame, key: str, targets: list[int]) -> DataFrame:
    """(target, found): the smallest key at or above each of a short list of targets, all in one pass; null beyond the end."""
    found = df.agg(*(F.min(F.when(F.col(key) >= t, F.col(key))).alias(str(t)) for t in targets))
    pairs = F.explode(F.array(*(F.struct(F.lit(t).cast("long").alias("target"), F.col(f"`{t}`").cast("long").alias("found")) for t in targets)))
    return found.select(pairs.alias("p")).select("p.*")


def excess_returns(changed: DataFrame, benchmark: str) -> DataFrame:
    """changed with bench and excess: the benchmark's change of the session, and the difference where both are known."""
    bench = changed.where(F.col("symbol") == benchmark).select("session", F.col("change").alias("bench"))
    return changed.join(bench, "session", "left").withColumn("excess", F.col("change") - F.col("bench"))


def newest(feeds: list[DataFrame], n: int) -> DataFrame:
    """The n newest rows of each symbol over several feeds of (symbol, source, id, day), with rn."""
    every = feeds[0]
    for f in feeds[1:]:
        every = every.unionByName(f)
    w = Window.partitionBy("symbol").orderBy(F.desc("day"), "source", F.desc("id"))
    return every.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def run_list(runs: DataFrame, job: str, at: str, key: str, n: int) -> DataFrame:
    """The latest run of each job and the n latest runs of all, each once."""
    latest = runs.groupBy(job).agg(F.max_by(F.struct(*runs.columns), F.struct(at, key)).alias("r")).select("r.*")
    return latest.union(runs.orderBy(F.desc(at), F.desc(key)).limit(n)).distinct()


def status_regressions(events: DataFrame, rank: Column) -> DataFrame:
    """events of (symbol, ts, event_id) whose status ranks below that of the event before."""
    before = F.lag(rank).over(Window.partitionBy("symbol").orderBy("ts", "event_id"))
    return events.withColumn("before", before).withColumn("rank", rank).where("rank < before")


def anchored_factors(priced: DataFrame) -> DataFrame:
    """priced (symbol, session, close, px) with factor: px over close, rescaled to 1 at the symbol's first session."""
    raw = F.try_divide(F.col("px"), F.nullif(F.col("close"), F.lit(0.0)))
    w = Window.partitionBy("symbol").orderBy("session").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return priced.withColumn("raw", raw).withColumn("factor", F.col("raw") / F.first("raw").over(w))
