"""Sector panels, forecasts with rolling validation, strength, leaders and flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import clip, full, guarded_corr, percent_rank_avg, zscore


def panel(returns: DataFrame, plates: DataFrame, least_members: int = 2, least_coverage: float = 0.8) -> DataFrame:
    """(plate, session, members, active, coverage, mean_ret, breadth, amount) from member returns; m:n membership. Every plate
    has every session after the first; a plate stays only if on each of them enough of its members have a return."""
    seen = returns.join(plates, "symbol").groupBy("plate", "session").agg(
        F.avg("ret").alias("mean_ret"),
        F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double"))).alias("breadth"),
        F.count("ret").alias("active"),
        F.sum("amount").alias("amount"),
    )
    days = returns.select("session").distinct().agg(F.array_sort(F.collect_list("session")).alias("days"))  # the calendar, in one row
    members = plates.groupBy("plate").agg(F.countDistinct("symbol").alias("members"))
    grid = members.crossJoin(F.broadcast(days)).select("plate", "members", F.explode(F.slice("days", 2, F.greatest(F.size("days") - 1, F.lit(0)))).alias("session"))
    d = grid.join(seen, ["plate", "session"], "left").withColumn("active", F.coalesce("active", F.lit(0)))
    d = d.withColumn("coverage", F.col("active") / F.col("members"))
    valid = (F.col("active") >= least_members) & (F.col("coverage") >= least_coverage) & F.col("mean_ret").isNotNull()
    return d.withColumn("__ok", F.bool_and(valid).over(Window.partitionBy("plate"))).where("__ok").drop("__ok")


def with_flows(p: DataFrame, flows: DataFrame) -> DataFrame:
    """p with flow: flows is (plate, session, flow), one row a key at most; a repeated key is an error at run time."""
    once = flows.groupBy("plate", "session").agg(F.count("*").alias("__n"), F.first("flow").alias("flow"))
    checked = F.when(F.col("__n") == 1, F.col("flow")).otherwise(F.raise_error(F.lit("a plate has two flows on one session")).cast("double"))
    return p.join(once.select("plate", "session", checked.alias("flow")), ["plate", "session"], "left")


def features(p: DataFrame, rsi: int = 14) -> DataFrame:
    """Index level, 5/10/20-session momenta, relative strength against the cross-section's median, RSI by simple means, and
    sums of flow over exactly five sessions. A session without a return has no level and moves no later one."""
    w = Window.partitionBy("plate").orderBy("session")
    day = Window.partitionBy("session")
    back = w.rowsBetween(-(rsi - 1), 0)
    grown = 100 * F.exp(F.sum(F.log(1 + F.greatest("mean_ret", F.lit(-0.999999)))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("level", F.when(F.col("mean_ret").isNotNull(), grown))
    for h in (5, 10, 20):
        p = p.withColumn(f"mom_{h}", F.try_divide(F.col("level"), F.lag("level", h).over(w)) - 1)
    gain = full(F.avg(F.greatest("mean_ret", F.lit(0.0))), "mean_ret", back, rsi)
    loss = full(F.avg(F.greatest(-F.col("mean_ret"), F.lit(0.0))), "mean_ret", back, rsi)
    p = p.withColumn("gain", gain).withColumn("loss", loss).withColumn("rs", F.col("mom_20") - F.median("mom_20").over(day))
    strength = F.when((F.col("gain") == 0) & (F.col("loss") == 0), 50.0).when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(F.col("gain"), F.col("loss"))))
    five = w.rowsBetween(-4, 0)
    p = p.withColumn("rsi", F.when(F.col("gain").isNotNull(), strength)).withColumn("flow_5", full(F.sum("flow"), "flow", five, 5))
    return p.withColumn("flow_turn", F.col("flow_5") - F.lag("flow_5").over(w)).withColumn("amount_change", F.try_divide(F.col("amount"), F.lag("amount", 5).over(w)) - 1)


def full_flows(p: DataFrame, sessions: int) -> DataFrame:
    """One row, use_flow: whether every plate has a flow on each of the newest `sessions` sessions, and there are so many."""
    per = p.groupBy("session").agg((F.count("flow") == F.count("*")).alias("ok"))
    newest = per.orderBy(F.desc("session")).limit(sessions)
    return newest.agg((F.count_if("ok") == sessions).alias("use_flow"))


def life_cycle(score: Column, trend: Column, rsi: Column, flow: Column) -> Column:
    """The stage by the first rule that holds; none without a score or a trend. Missing rsi and flow satisfy no rule."""
    return (
        F.when(score.isNull() | trend.isNull(), None).when((score > 80) & (rsi > 70), "boom").when((score > 60) & (trend > 0), "rising")
        .when((trend < 0) & (score < 60), "decline").when((score < 30) & (trend >= 0), "bottoming").when(score.between(30, 60) & (trend > 0) & (flow > 0), "recovery")
    )


def scores(p: DataFrame, horizon: int = 20, flow_sessions: int = 84) -> DataFrame:
    """Percentile score of momentum, breadth and relative strength, and of flow where flows are complete; trend, life-cycle
    stage and, with flows, reversal score."""
    day = ["session"]
    d = p.crossJoin(F.broadcast(full_flows(p, flow_sessions)))  # one row
    # fixed values: weights of the sector score
    part = 0.35 * F.col(f"mom_{horizon}") + 0.20 * zscore("breadth", day) + 0.20 * zscore("rs", day)
    raw = F.when(F.col("use_flow"), part + 0.25 * zscore("flow_5", day)).otherwise(part / 0.75)
    d = d.withColumn("raw", F.round(raw, 9)).withColumn("score", percent_rank_avg("raw", day) * 100)
    w = Window.partitionBy("plate").orderBy("session")
    d = d.withColumn("trend", F.col("score") - F.lag("score", 5).over(w))
    s, t, r = F.col("score"), F.col("trend"), F.col("rsi")
    reversal = 0.40 * (100 - s) + 0.40 * zscore("flow_turn", day) + 0.20 * F.greatest(35 - r, F.lit(0.0))
    reversal = F.when(F.col("use_flow") & r.isNotNull(), F.round(reversal, 9))
    d = d.withColumn("stage", life_cycle(s, t, r, F.col("flow_5"))).withColumn("__rev", reversal)
    return d.withColumn("reversal", percent_rank_avg("__rev", day) * 100).drop("__rev", "raw")


def validation(scored: DataFrame, horizon: int, origins: int = 60, share: float = 0.2) -> DataFrame:
    """One row: over the last `origins` sessions with a score and a known forward return, the top share by score (ties to the
    lower plate): win rate against the day's median and mean excess. Fewer sessions are an error at run time."""
    w = Window.partitionBy("plate").orderBy("session")
    day = Window.partitionBy("session")
    d = scored.withColumn("future", F.try_divide(F.lead("level", horizon).over(w), F.col("level")) - 1)
    d = d.withColumn("mid", F.median("future").over(day)).where("score is not null and future is not null")
    d = d.withColumn("rank", F.row_number().over(day.orderBy(F.desc("score"), "plate"))).withColumn("n", F.count("*").over(day))
    top = d.where(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("n") * share)))
    last = top.select("session").distinct().orderBy(F.desc("session")).limit(origins)
    picked = top.join(F.broadcast(last), "session", "left_semi")
    g = picked.agg(
        F.countDistinct("session").alias("origins"), F.count("*").alias("samples"), F.avg((F.col("future") > F.col("mid")).cast("double")).alias("win_rate"),
        F.avg(F.col("future") - F.col("mid")).alias("expected_excess"),
    )
    enough = F.when(F.col("origins") >= origins, F.col("origins")).otherwise(F.raise_error(F.lit("too few sessions to validate on")).cast("long"))
    return g.withColumn("origins", enough)


def strength(quotes: DataFrame, top: int = 30) -> DataFrame:
    """Strength of a plate's `top` members by turnover: mean change, breadth, clipped score, leading member."""
    w = Window.partitionBy("plate", "session").orderBy(F.desc("amount"), "symbol")
    d = quotes.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top)
    g = d.groupBy("plate", "session").agg(
        F.avg("change").alias("mean_change"), F.avg((F.col("change") > 0).cast("double")).alias("breadth"),
        F.max_by("symbol", F.struct("change", F.col("symbol"))).alias("leader"), F.count("*").alias("members"),
    )
    return g.withColumn("strength", clip(5 + 1.2 * F.col("mean_change") + 4 * (F.col("breadth") - 0.5), 0.0, 10.0))


def leaders(quotes: DataFrame, least: float = 0.8) -> DataFrame:
    """The member with the largest change of each plate and session (ties to the lower symbol), where enough members report."""
    w = Window.partitionBy("plate", "session")
    d = quotes.withColumn("__c", F.round("change", 12)).withColumn("coverage", F.count("change").over(w) / F.count("*").over(w))
    d = d.withColumn("__n", F.row_number().over(w.orderBy(F.desc_nulls_last("__c"), "symbol")))
    return d.where((F.col("__n") == 1) & (F.col("coverage") >= least) & F.col("change").isNotNull()).drop("__n", "__c")


def leader_correlation(returns: DataFrame, plates: DataFrame, lead: DataFrame, least: int = 20) -> DataFrame:
    """(plate, symbol, n, corr): each member's return correlation with its plate's leader. lead is (plate, leader)."""
    of_leader = lead.join(returns.select(F.col("symbol").alias("leader"), "session", F.col("ret").alias("leader_ret")), "leader")
    pairs = plates.join(lead, "plate").where("symbol <> leader").select("plate", "symbol")
    both = pairs.join(returns.select("symbol", "session", "ret"), "symbol").join(of_leader.select("plate", "session", "leader_ret"), ["plate", "session"])
    return guarded_corr(both, "ret", "leader_ret", ["plate", "symbol"], "corr", least)


def window_leaders(bars: DataFrame, plates: DataFrame, benchmark: str, lookback: int = 20) -> DataFrame:
    """(plate, rank, symbol, leader, total, n, corr): a plate's members by the correlation of their daily returns with those of
    the member with the largest return over the benchmark's last `lookback` sessions (ties: lower symbol). Only members with a
    close on every one of these sessions and the one before, and returns that vary, take part; the leader itself has no row,
    nor has a plate with fewer than two of them, nor any if the benchmark has too few sessions."""
    ok = bars.where((F.col("close") > 0) & (F.col("close") < float("inf")))
    days = ok.where(F.col("symbol") == benchmark).select("session").distinct().orderBy(F.desc("session")).limit(lookback + 1)
    w = Window.partitionBy("symbol").orderBy("session")
    each = ok.join(F.broadcast(days), "session", "left_semi").select("symbol", "session", "close")
    each = each.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    per = each.groupBy("symbol").agg(F.count("*").alias("__n"), F.stddev_pop("ret").alias("__s"), (F.max_by("close", "session") / F.min_by("close", "session") - 1).alias("total"))
    members = plates.join(per.where((F.col("__n") == lookback + 1) & (F.col("__s") > 1e-12)).select("symbol", "total"), "symbol")
    lead = members.groupBy("plate").agg(F.min(F.struct((-F.col("total")).alias("t"), "symbol")).alias("l")).select("plate", F.col("l.symbol").alias("leader"))
    of_leader = lead.join(each.select(F.col("symbol").alias("leader"), "session", F.col("ret").alias("__r")), "leader")
    both = members.join(each.select("symbol", "session", "ret"), "symbol").join(of_leader, ["plate", "session"]).where("symbol <> leader")
    linked = guarded_corr(both, "ret", "__r", ["plate", "symbol", "leader", "total"], "corr", lookback)
    return linked.withColumn("rank", F.row_number().over(Window.partitionBy("plate").orderBy(F.desc(F.round("corr", 12)), "symbol")))


def exact_days(flows: DataFrame, days: int = 5) -> DataFrame:
    """(plate, flow): the sum over exactly the newest `days` sessions, from one source; otherwise the plate is missing."""
    wanted = flows.select("session").distinct().orderBy(F.desc("session")).limit(days)
    g = flows.join(F.broadcast(wanted), "session", "left_semi").groupBy("plate").agg(
        F.sum("flow").alias("flow"), F.count("flow").alias("__n"), F.countDistinct("session").alias("__d"), F.countDistinct("source").alias("__s")
    )
    return g.where((F.col("__n") == days) & (F.col("__d") == days) & (F.col("__s") == 1)).select("plate", "flow")


def top_member_flow(members: DataFrame, k: int = 5) -> DataFrame:
    """(plate, session, flow): the sum over the k members with the largest cap; null unless all of them report."""
    w = Window.partitionBy("plate", "session").orderBy(F.desc("cap"), "symbol")
    top = members.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k)
    return top.groupBy("plate", "session").agg(F.when(F.count("flow") == F.count("*"), F.sum("flow")).alias("flow"), F.count("*").alias("members"))
