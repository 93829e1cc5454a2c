"""Market breadth, sentiment, monitor feeds, outcomes, portfolio and trade arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import full


def breadth(quotes: DataFrame, by: list[str]) -> DataFrame:
    """Breadth of quotes (change in percent, last, high, limit_up, limit_down, amount): counts, sums, mean, exact median."""
    c = F.col("change")
    up, touched = F.col("last") >= F.col("limit_up"), F.col("high") >= F.col("limit_up")
    return quotes.where(c.isNotNull()).groupBy(*by).agg(
        F.count_if(c > 0).alias("advancers"), F.count_if(c < 0).alias("decliners"), F.count_if(c == 0).alias("unchanged"),
        F.count_if(up).alias("limit_up_n"), F.count_if(F.col("last") <= F.col("limit_down")).alias("limit_down_n"), F.count_if(touched & ~up).alias("broken"),
        F.count_if(c > 4).alias("up_4"), F.count_if(c < -4).alias("down_4"), F.sum("amount").alias("amount"), F.avg("change").alias("mean_change"), F.median("change").alias("median_change"),
    )


def observations(b: DataFrame) -> DataFrame:
    """b with breadth share (null without movers), limit ecology, volume (amount over that of the session before, less one;
    null unless both are positive) and broken rate."""
    a, d = F.col("advancers"), F.col("decliners")
    w = Window.orderBy("ts")  # one row a time step, however many quotes each summed up
    amount = F.when(F.col("amount") > 0, F.col("amount"))
    b = b.withColumns({"share": F.try_divide(a, F.nullif(a + d, F.lit(0))), "ecology": (F.col("limit_up_n") - F.col("broken")).cast("double"), "amount": amount})
    broken = F.try_divide(F.col("broken") * 100.0, F.nullif(F.col("limit_up_n") + F.col("broken"), F.lit(0)))
    return b.withColumns({"volume": F.try_divide(F.col("amount"), F.lag("amount").over(w)) - 1, "broken_rate": broken})


def index_volatility(index: DataFrame, days: int = 20) -> DataFrame:
    """(ts, volatility): annualised deviation of the last `days` returns of an index (ts, close); null until there are enough."""
    w = Window.orderBy("ts")  # one row a session
    r = index.withColumn("__r", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    return r.select("ts", (full(F.stddev_pop("__r"), "__r", w.rowsBetween(1 - days, 0), days) * F.sqrt(F.lit(252.0))).alias("volatility"))


def trailing_rank(df: DataFrame, value: str, out: str, history: int, sample: str | None = None) -> DataFrame:
    """df (ts, value) with out: the scaled rank (0..100) of each value among the last `history` non-null samples up to its own
    row, and out_n, their number. Later rows change nothing. One sample, or equal ones, rank at 50."""
    sample = sample or value
    w = Window.orderBy("ts")  # one row a session
    d = df.withColumn("__nn", F.count(sample).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    past = F.collect_list(sample).over(Window.orderBy("__nn").rangeBetween(1 - history, 0))
    d = d.withColumn("__s", past)
    v, n = F.col(value), F.size("__s")
    less, same = F.size(F.filter("__s", lambda x: x < v)), F.size(F.filter("__s", lambda x: x == v))
    rank = F.when(v.isNull() | (n == 0), None).when((n == 1) | (F.array_max("__s") == F.array_min("__s")), 50.0).otherwise((less + (same - 1) / 2) / (n - 1) * 100)
    return d.withColumn(out, rank).withColumn(f"{out}_n", n).drop("__nn", "__s")


def sentiment(obs: DataFrame, index: DataFrame, history: int = 250) -> DataFrame:
    """Weighted total of four components, each ranked 0..100 against its own last `history` values up to the session; a missing
    component counts 50. degraded names components that are missing or have no earlier value. index is (ts, close); the
    volatility of a session without an index close is that of the last one."""
    # fixed values: weights of the components
    parts = {"share": 0.30, "volume": 0.25, "ecology": 0.25, "volatility": 0.20}
    d = obs.join(index_volatility(index).withColumnRenamed("volatility", "__vol"), "ts", "left")
    d = d.withColumn("volatility", F.last("__vol", ignorenulls=True).over(Window.orderBy("ts")))  # one row a session
    for p in parts:
        d = trailing_rank(d, p, f"r_{p}", history, "__vol" if p == "volatility" else None)
    d = d.drop("__vol").withColumn("r_volatility", 100 - F.col("r_volatility"))
    poor = {p: F.col(f"r_{p}").isNull() | (F.col(f"r_{p}_n") < 2) for p in parts}
    d = d.withColumn("degraded", F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(p)) for p, c in poor.items()))), ","))
    total = sum((F.coalesce(f"r_{p}", F.lit(50.0)) * v for p, v in parts.items()), F.lit(0.0))
    d = d.withColumn("sentiment", total).withColumn("label", sentiment_label(F.col("sentiment")))
    # a label of a component is given only where it has a history
    safe = {p: F.when(~poor[p], sentiment_label(F.coalesce(f"r_{p}", F.lit(50.0)))) for p in ("ecology", "volume", "volatility")}
    return d.withColumns({"money_effect": safe["ecology"], "liquidity": safe["volume"], "risk_hint": safe["volatility"]})


def sentiment_label(x: Column) -> Column:
    return F.when(x < 30, "coldest").when(x < 45, "weak").when(x < 60, "neutral").when(x <= 75, "strong").when(x > 75, "hottest")


def changes(obs: DataFrame) -> DataFrame:
    """(ts, kind, delta): events between neighbouring observations: amount by 5 %, the balance of advancers and decliners
    changing its sign (a tie does not), limit-ups by 5, broken rate rising over 30 %, label."""
    w = Window.orderBy("ts")  # one row a time step, however many quotes each summed up
    d = obs.withColumn("balance", F.col("advancers") - F.col("decliners"))
    names = ("amount", "balance", "share", "limit_up_n", "broken_rate", "label")
    d = d.select("ts", *names, *(F.lag(c).over(w).alias(f"p_{c}") for c in names), F.lag("ts").over(w).alias("p_ts"))
    rel = F.try_divide(F.col("amount"), F.col("p_amount")) - 1
    up = (F.col("limit_up_n") - F.col("p_limit_up_n")).cast("double")
    crossed = F.col("p_ts").isNotNull() & (F.col("broken_rate") > 30) & F.coalesce(F.col("p_broken_rate") <= 30, F.lit(True))
    found = F.array_compact(F.array(
        F.when(F.abs(rel) >= 0.05, F.struct(F.lit("amount").alias("kind"), rel.alias("delta"))),
        F.when(F.col("balance") * F.col("p_balance") < 0, F.struct(F.lit("breadth").alias("kind"), (F.col("share") - F.col("p_share")).alias("delta"))),
        F.when(F.abs(up) >= 5, F.struct(F.lit("limit_up").alias("kind"), up.alias("delta"))),
        F.when(crossed, F.struct(F.lit("broken").alias("kind"), F.col("broken_rate").alias("delta"))),
        F.when(F.col("label") != F.col("p_label"), F.struct(F.lit("label").alias("kind"), F.lit(None).cast("double").alias("delta"))),
    ))
    return d.select("ts", F.explode(found).alias("e")).select("ts", "e.kind", "e.delta")


def leader_changes(strength: DataFrame) -> DataFrame:
    """(ts, before, after, strength): sessions whose strongest plate differs from that of the session before. strength is
    (ts, plate, rank, strength); the strongest has the lowest rank, then the largest strength, then the lowest plate."""
    key = F.struct(F.coalesce("rank", F.lit(2**31 - 1)), -F.coalesce("strength", F.lit(float("-inf"))), F.col("plate"))
    top = strength.where("plate is not null").groupBy("ts").agg(F.min_by(F.struct("plate", "strength"), key).alias("t")).select("ts", "t.*")
    d = top.withColumn("before", F.lag("plate").over(Window.orderBy("ts")))  # one row a session
    return d.where(F.col("before") != F.col("plate")).select("ts", "before", F.col("plate").alias("after"), "strength")


def merged_feed(feeds: list[DataFrame], n: int) -> DataFrame:
    """The n newest rows (ts, kind, text) of several producers: by time, then the later producer, then the later row of it."""
    every = None
    for i, f in enumerate(feeds):
        f = f.select("ts", "kind", "text", F.lit(i).alias("producer"))
        every = f if every is None else every.unionByName(f)
    return every.orderBy(F.desc("ts"), F.desc("producer"), F.desc("kind"), F.desc("text")).limit(n)


def outcomes(signals: DataFrame, closes: DataFrame, horizon: int) -> DataFrame:
    """signals (symbol, session, action, position_change) with the return over the next `horizon` calendar sessions, hit
    (null for actions without a direction) and contribution. Both ends must have a bar; immature signals are left out."""
    cal = closes.select("session").distinct()
    w = Window.orderBy("session")  # the list of sessions
    ends = cal.select("session", F.lead("session", horizon).over(w).alias("mature_on"))
    d = signals.join(F.broadcast(ends), "session").where(F.col("mature_on").isNotNull())
    d = d.join(closes.select("symbol", "session", F.col("close").alias("entry")), ["symbol", "session"])
    d = d.join(closes.select("symbol", F.col("session").alias("mature_on"), F.col("close").alias("exit")), ["symbol", "mature_on"])
    r = F.try_divide(F.col("exit"), F.col("entry")) - 1
    hit = F.when(F.col("position_change") > 0, F.col("ret") > 0).when(F.col("position_change") < 0, F.col("ret") < 0)
    return d.withColumn("ret", r).withColumn("hit", hit).withColumn("contribution", F.col("position_change") * F.col("ret") + 0.0)


def attribution(out: DataFrame, dims: list[str]) -> DataFrame:
    """One output of counts, hits, rate and contribution for each value of each dimension: grouping sets, one pass."""
    g = out.groupingSets([[F.col(d)] for d in dims], *(F.col(d) for d in dims)).agg(
        F.count("*").alias("n"), F.count("hit").alias("directional"), F.count_if("hit").alias("hits"), F.sum("contribution").alias("contribution")
    )
    return g.withColumn("rate", F.try_divide(F.col("hits"), F.nullif(F.col("directional"), F.lit(0))))


def volatility_groups(out: DataFrame, vol: DataFrame) -> DataFrame:
    """out (symbol, session, ...) with tercile: low, mid or high by the linear thirds of the session's whole cross-section of vol
    (symbol, session, z); insufficient with under three values or three different ones, unavailable without a value."""
    known = vol.where("z is not null")
    q = known.groupBy("session").agg(F.percentile("z", [1 / 3, 2 / 3]).alias("__q"), F.count("*").alias("__n"), F.countDistinct("z").alias("__d"))
    j = out.join(known.select("symbol", "session", "z"), ["symbol", "session"], "left").join(q, "session", "left")
    z, enough = F.col("z"), (F.col("__n") >= 3) & (F.col("__d") >= 3)
    group = F.when(z.isNull(), "unavailable").when(~enough, "insufficient").when(z <= F.col("__q")[0], "low").when(z <= F.col("__q")[1], "mid").otherwise("high")
    return j.withColumn("tercile", group).drop("z", "__q", "__n", "__d")


def single_plate(out: DataFrame, plates: DataFrame) -> DataFrame:
    """out with plate: the plate of a symbol that has exactly one, else "unknown"."""
    one = plates.groupBy("symbol").agg(F.countDistinct("plate").alias("__n"), F.min("plate").alias("plate")).where("__n = 1").drop("__n")
    return out.join(one, "symbol", "left").withColumn("plate", F.coalesce("plate", F.lit("unknown")))


def decile_outcomes(scored: DataFrame, score: str, ret: str) -> DataFrame:
    """(decile, samples, positives, rate) for all ten deciles of a 0..100 score; empty ones have a null rate."""
    d = scored.where(F.col(score).isNotNull() & F.col(ret).isNotNull()).withColumn("decile", F.least(F.floor(F.col(score) / 10) + 1, F.lit(10)).cast("int"))
    g = d.groupBy("decile").agg(F.count("*").alias("samples"), F.count_if(F.col(ret) > 0).alias("positives"))
    every = scored.sparkSession.range(1, 11).select(F.col("id").cast("int").alias("decile"))
    g = every.join(g, "decile", "left").fillna(0, ["samples", "positives"])
    return g.withColumn("rate", F.try_divide(F.col("positives"), F.nullif(F.col("samples"), F.lit(0))))


def trade_cost(amount: Column, sell: Column) -> Column:
    """Commission (at least 5), stamp duty on sales, transfer fee and slippage; nothing for no trade."""
    # fixed values: rates of the cost model
    parts = F.greatest(amount * 0.00025, F.lit(5.0)) + F.when(sell, amount * 0.001).otherwise(0.0) + amount * 0.00002 + amount * 0.0005
    return F.when(amount <= 0, 0.0).otherwise(parts)


def order_size(cash: Column, price: Column) -> Column:
    """Whole lots of a hundred that the cash buys."""
    return (F.floor(F.try_divide(cash, price) / 100) * 100).cast("long")


def order_limit(price: Column, buy: Column) -> Column:
    """One per cent towards the market, rounded away from it to a cent in decimals."""
    up, down = (price * 1.01).cast("decimal(18,6)"), (price * 0.99).cast("decimal(18,6)")
    return F.when(buy, F.ceil(up * 100) / 100).otherwise(F.floor(down * 100) / 100).cast("double")


def guardrails(proposals: DataFrame, live: bool = False, gateway: bool = True) -> DataFrame:
    """proposals (mode, side, confidence, notional, equity, cash, position, sector, day_pnl, open_orders, age) with reasons (sorted
    text, empty if none), approved and confirm. Shares are of equity; age is in seconds. Missing inputs refuse."""
    # fixed values: default limits
    confidence, single, sector, loss, stale = 0.68, 0.10, 0.30, 0.02, 120
    c = F.col
    order = F.try_divide(c("notional"), c("equity"))
    after = c("position") + F.when(c("side") == "BUY", order).otherwise(-order)

    def unless(ok: Column) -> Column:
        return ~F.coalesce(ok, F.lit(False))

    rules = {
        "mode": unless(~c("mode").isin("RESEARCH", "OBSERVE", "ALERT")),
        "live_disabled": (c("mode") == "LIMITED_LIVE_AUTO") & F.lit(not live),
        "gateway_disabled": c("mode").isin("PAPER_AUTO", "LIMITED_LIVE_AUTO") & F.lit(not gateway),
        "confidence": unless(c("confidence") >= confidence),
        "future_data": unless(c("age") >= -5),
        "stale_data": unless(c("age") <= stale),
        "single_position": unless(after <= single),
        "oversell": (c("side") == "SELL") & unless(after >= -1e-9),
        "sector_exposure": unless(c("sector") + F.greatest(order, F.lit(0.0)) <= sector),
        "daily_loss": unless(c("day_pnl") > -loss),
        "open_order": unless(c("open_orders") <= 0),
        "cash": (c("side") == "BUY") & unless(c("notional") <= c("cash")),
    }
    reasons = F.array_join(F.array_sort(F.array_compact(F.array(*(F.when(r, F.lit(k)) for k, r in rules.items())))), ",")
    d = proposals.withColumn("reasons", reasons).withColumn("approved", F.col("reasons") == "")
    return d.withColumn("confirm", F.coalesce(c("mode").isin("CONFIRM_TO_TRADE", "LIMITED_LIVE_AUTO"), F.lit(False)))


def thesis_drift(probabilities: DataFrame, step: int = 5, band: float = 0.08) -> DataFrame:
    """(symbol, session, p, drift): p_up against that of `step` observations ago."""
    w = Window.partitionBy("symbol").orderBy("session")
    delta = F.col("p") - F.lag("p", step).over(w)
    drift = F.when(delta > band + 1e-12, "strengthened").when(delta < -band - 1e-12, "weakened").when(delta.isNotNull(), "unchanged")
    return probabilities.withColumn("drift", drift)


def style(df: DataFrame) -> DataFrame:
    """df with style: defensive, value, growth or balanced by the first rule that holds; nulls never satisfy one."""
    # fixed values: thresholds of the rules
    tag = (
        F.when(F.col("defensive") | (F.col("vol_z") < -0.5), "defensive").when((F.col("pe_pct") < 0.4) & (F.col("pb_pct") < 0.4), "value")
        .when((F.col("profit_z") > 0.5) & (F.col("pe_pct") > 0.5), "growth").otherwise("balanced")
    )
    return df.withColumn("style", tag)


STYLES = ("defensive", "value", "growth", "balanced")


def style_weights(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, style, n, weight): turnover share of all four tags, absent ones 0."""
    g = df.groupBy(*by, "style").agg(F.count("*").alias("n"), F.sum("amount").alias("a"))
    grid = g.select(*by).distinct().withColumn("style", F.explode(F.array(*(F.lit(t) for t in STYLES))))
    full = grid.join(g, [*by, "style"], "left").fillna(0, ["n"]).fillna(0.0, ["a"])
    return full.withColumn("weight", F.coalesce(F.try_divide(F.col("a"), F.sum("a").over(Window.partitionBy(*by))), F.lit(0.0)))


def style_row(df: DataFrame, by: list[str]) -> DataFrame:
    """One row of by with a weight column for each tag."""
    w = style_weights(df, by)
    return w.groupBy(*by).agg(*(F.max(F.when(F.col("style") == t, F.col("weight"))).alias(t) for t in STYLES))


def style_exposure(candidates: DataFrame, by: list[str]) -> DataFrame:
    """(by, style, n, share): the candidates of a run by style, all four tags; an unknown tag is an error at run time."""
    ok = F.coalesce(F.col("style").isin(*STYLES), F.lit(False))
    checked = F.when(ok, F.col("style")).otherwise(F.raise_error(F.lit("a candidate has no style")))
    g = candidates.withColumn("style", checked).groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col("style") == t).alias(t) for t in STYLES))
    d = g.unpivot([*by, "total"], list(STYLES), "style", "n")
    return d.withColumn("share", F.try_divide(F.col("n"), F.col("total"))).drop("total")


def preselect(df: DataFrame, value: str, score: str, by: list[str], n: int) -> DataFrame:
    """The n best of each cross-section: rows with a value first, then by value (else score / 100), then score, then symbol."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.col(value).isNotNull().cast("int")), F.desc(F.coalesce(F.col(value), F.col(score) / 100)), F.desc(score), "symbol")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def risk_terciles(df: DataFrame, vol: str, by: list[str]) -> DataFrame:
    """df with risk low, medium or high by the linear thirds of the cross-section."""
    q = df.groupBy(*by).agg(F.percentile(vol, F.lit(1 / 3)).alias("__a"), F.percentile(vol, F.lit(2 / 3)).alias("__b"))
    v = F.col(vol)
    return df.join(q, by).withColumn("risk", F.when(v.isNull(), None).when(v <= F.col("__a"), "low").when(v <= F.col("__b"), "medium").otherwise("high")).drop("__a", "__b")


def screen_diff(runs: DataFrame) -> DataFrame:
    """(session, symbol, status): new, dropped or stayed against the run before."""
    days = runs.select("session").distinct()
    nxt = days.withColumn("next", F.lead("session").over(Window.orderBy("session")))  # the list of runs
    before = runs.join(F.broadcast(nxt), "session").where(F.col("next").isNotNull()).select(F.col("next").alias("session"), "symbol", F.lit(1).alias("__b"))
    first = days.agg(F.min("session").alias("__first"))
    both = runs.withColumn("__a", F.lit(1)).join(before, ["session", "symbol"], "full")
    both = both.crossJoin(F.broadcast(first)).where("session <> __first")  # one row
    return both.select("session", "symbol", F.when(F.col("__b").isNull(), "new").when(F.col("__a").isNull(), "dropped").otherwise("stayed").alias("status"))
