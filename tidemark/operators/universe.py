"""Point-in-time universes, memberships and the full factor cross-section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import AUDITED, ZONE, cutoff
from tidemark.functions.stats import percent_rank_avg


def st_known(snapshot: Column, day: Column) -> Column:
    """Whether a snapshot shows the status of a day: taken on that local day, by the decision time."""
    return F.coalesce((F.to_date(F.from_utc_timestamp(snapshot, ZONE)) == day) & (snapshot <= cutoff(day)), F.lit(False))


def eligible(securities: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, session, st_known): listed securities with an audited bar of positive close, volume and amount, but those that
    are known to be ST on the session. securities: symbol, market, list_status, is_st, snapshot_at; bars carry a source."""
    listed = securities.where("market = 'CN' and list_status = 'listed'").select("symbol", "is_st", "snapshot_at")
    b = bars.where(F.col("source").isin(*AUDITED) & (F.col("close") > 0) & (F.col("volume") > 0) & (F.col("amount") > 0)).select("symbol", "session")
    j = b.join(listed, "symbol").withColumn("st_known", st_known(F.col("snapshot_at"), F.col("session")))
    return j.where(~(F.col("st_known") & F.coalesce("is_st", F.lit(False)))).select("symbol", "session", "st_known")


def backtest_universe(securities: DataFrame, bars: DataFrame, age: int = 60) -> DataFrame:
    """(symbol, session, basis, is_st): securities with an audited bar of positive close and volume that are listed for `age`
    days, by their listing date or, where that is not a date, by their first audited bar; is_st is null where unknown."""
    audited = bars.where(F.col("source").isin(*AUDITED))
    first = audited.groupBy("symbol").agg(F.min("session").alias("first_bar"))
    listed = F.col("listed_date").try_cast("date")
    s = securities.where("market = 'CN' and list_status = 'listed'").withColumn("listed", listed).join(first, "symbol", "left")
    s = s.select("symbol", "is_st", "snapshot_at", F.coalesce("listed", "first_bar").alias("since"), F.when(F.col("listed").isNotNull(), "master").otherwise("first_bar").alias("basis"))
    j = audited.where("close > 0 and volume > 0").select("symbol", "session").join(s, "symbol").where(F.col("since") <= F.date_sub("session", age))
    known = F.when(st_known(F.col("snapshot_at"), F.col("session")), F.coalesce("is_st", F.lit(False)))
    return j.select("symbol", "session", "basis", known.alias("is_st"))


def endpoint_return(px: DataFrame, entry: Column, leave: Column) -> DataFrame:
    """(symbol, ret): adjusted price of one session over that of another, less 1; null unless both are positive. One pass."""
    at = lambda d: F.max(F.when(F.col("session") == d, F.col("px")))
    g = px.where((F.col("session") == entry) | (F.col("session") == leave)).groupBy("symbol").agg(at(entry).alias("a"), at(leave).alias("b"))
    ok = (F.col("a") > 0) & (F.col("b") > 0)
    return g.select("symbol", F.when(ok, F.when(entry == leave, 0.0).otherwise(F.try_divide(F.col("b"), F.col("a")) - 1)).alias("ret"))


def memberships(snapshots: DataFrame, current: DataFrame, at: Column, day: Column) -> DataFrame:
    """(plate, symbol, origin): the members of each plate on a day: those of the day's snapshot known by then, else the current
    list as far as it was refreshed by then. snapshots: plate, symbol, as_of, available; current: plate, symbol, refreshed."""
    exact = snapshots.where((F.col("as_of") == day) & (F.col("available") <= at)).select("plate", "symbol").distinct()
    now = current.where(F.col("refreshed") <= at).select("plate", "symbol").distinct()
    fallback = now.join(exact.select("plate").distinct(), "plate", "left_anti")
    return exact.withColumn("origin", F.lit("snapshot")).union(fallback.select("plate", "symbol").withColumn("origin", F.lit("current")))


def plate_lists(members: DataFrame) -> DataFrame:
    """(symbol, plates): the sorted plates of each symbol."""
    return members.groupBy("symbol").agg(F.array_sort(F.collect_set("plate")).alias("plates"))


def latest_strength(snapshots: DataFrame) -> DataFrame:
    """(day, plate, strength): the finite strengths of the newest snapshot (as_of, id) of each day. payload is an array of
    structs of plate and strength."""
    newest = snapshots.groupBy("day").agg(F.max_by("payload", F.struct("as_of", "id")).alias("payload"))
    each = newest.select("day", F.explode("payload").alias("p")).select("day", "p.plate", F.col("p.strength").try_cast("double").alias("strength"))
    return each.where(F.col("strength").isNotNull() & ~F.isnan("strength") & (F.abs("strength") != float("inf")) & (F.trim("plate") != ""))


def symbol_mean(members: DataFrame, values: DataFrame, value: str, out: str) -> DataFrame:
    """(symbol, session, out): the mean over a symbol's plates of a plate value by session."""
    return members.select("plate", "symbol").join(values.select("plate", "session", value), "plate").groupBy("symbol", "session").agg(F.avg(value).alias(out))


def five_session_flow(flows: DataFrame) -> DataFrame:
    """(plate, session, flow_5): the sum of a plate's flows over exactly the newest five sessions of the calendar."""
    cal = flows.select("session").distinct().withColumn("ord", F.row_number().over(Window.orderBy("session")))  # the list of sessions
    d = flows.join(F.broadcast(cal), "session")
    w = Window.partitionBy("plate").orderBy("ord").rangeBetween(-4, 0)
    return d.withColumn("n", F.count("flow").over(w)).withColumn("flow_5", F.sum("flow").over(w)).where("n = 5").select("plate", "session", "flow_5")


def known_facts(sessions: DataFrame, facts: DataFrame, metrics: list[str]) -> DataFrame:
    """sessions (symbol, session) with, for each metric, the non-null value of the newest period that was available by the
    session: one window over the union of both, no pairs."""
    known = facts.where(F.col("value").isNotNull() & F.col("metric").isin(metrics))
    rows = sessions.select("symbol", "session", F.lit(1).alias("side"), *(F.lit(None).cast("string").alias(c) for c in ("metric", "period")), F.lit(None).cast("double").alias("value"))
    every = rows.union(known.select("symbol", F.col("available").alias("session"), F.lit(0), "metric", "period", "value"))
    w = Window.partitionBy("symbol").orderBy("session", "side").rowsBetween(Window.unboundedPreceding, 0)
    own = {m: F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, F.col("period"))).over(w) for m in metrics}
    return every.select("symbol", "session", "side", *(c.alias(m) for m, c in own.items())).where("side = 1").drop("side")


def cross_section(price: DataFrame, facts: DataFrame, metrics: list[str], valuations: DataFrame, inflow: DataFrame, strength: DataFrame) -> DataFrame:
    """All factors of every (symbol, session) of price in one plan: price factors, the newest known financials, ranks of positive
    valuations among the session's symbols, mean flow and strength of a symbol's plates."""
    d = price.join(known_facts(price, facts, metrics), ["symbol", "session"], "left")
    d = d.join(valuations.select("symbol", *(F.when(F.col(c) > 0, F.col(c)).alias(f"__{c}") for c in ("pe", "pb"))), "symbol", "left")
    d = d.join(inflow, ["symbol", "session"], "left").join(strength, ["symbol", "session"], "left")
    return d.withColumns({f"{c}_percentile": percent_rank_avg(f"__{c}", ["session"]) for c in ("pe", "pb")}).drop("__pe", "__pb")
