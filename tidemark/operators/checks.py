"""Provenance of signals, integrity of stored rows, verdicts on research runs, and feeds of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import ZONE, finite, local_seconds
from tidemark.functions.stats import clip

# fixed values: actions that buy, that sell, and that do neither
BUY, SELL, NEUTRAL = ("BUY_CANDIDATE", "ADD"), ("REDUCE", "EXIT", "STOP"), ("WATCH", "HOLD", "REVIEW", "REVIEW_REQUIRED")
# fixed values: a forecast belongs to an alert made within so many seconds; a proposal may exceed its alert by five percent;
# the session's bar is complete at 15:06 local time
MATCH_SECONDS, NOTIONAL_SLACK, COMPLETE = 5, 1.05, 15 * 3600 + 6 * 60
#: White space of any script, as a regular expression.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _failed(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, in order; a check on missing values holds."""
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items())), lambda x: x.isNotNull())


def local_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), ZONE))


# ---------------------------------------------------------------- signals


def capital_anomalies(quotes: DataFrame, watch: DataFrame) -> DataFrame:
    """(symbol, direction, strength, reasons) of watched quotes (symbol, change, turnover) that moved by 7 percent or turned
    over 10 percent; a missing turnover is no reason."""
    moved, turned = F.abs("change") >= 7, F.coalesce(F.col("turnover") >= 10, F.lit(False))
    # greatest and least skip nulls, clip keeps them
    strength = F.greatest(clip(F.abs("change") / 10, 0.0, 1.0), clip(F.col("turnover") / 20, 0.0, 1.0))
    return quotes.join(watch.select("symbol"), "symbol", "left_semi").where(moved | turned).select(
        "symbol", clip(F.col("change") / 10, -1.0, 1.0).alias("direction"), strength.alias("strength"),
        F.concat_ws("+", F.when(moved, "price"), F.when(turned, "turnover")).alias("reasons"),
    )


def provenance(alerts: DataFrame, forecasts: DataFrame, audited) -> DataFrame:
    """(id, forecast_id, provider, verified) for every alert (id, symbol, as_of, model, created): of the forecasts (id, symbol,
    as_of, model, created, provider) of the same symbol, evidence time and model that nearest in time, within MATCH_SECONDS.
    Only forecasts in the same or a neighbouring stretch of MATCH_SECONDS are compared."""
    at = F.unix_micros(F.col("created").cast("timestamp"))
    stretch = F.floor(at / (MATCH_SECONDS * 1_000_000))
    left = alerts.where(F.col("as_of").isNotNull() & (F.col("model") != "")).select("id", "symbol", "as_of", "model", at.alias("at"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    right = forecasts.select(F.col("id").alias("forecast_id"), "symbol", "as_of", "model", "provider", at.alias("seen"), stretch.alias("stretch"))
    gap = F.abs(F.col("at") - F.col("seen"))
    near = left.join(right, ["symbol", "as_of", "model", "stretch"]).where(gap <= MATCH_SECONDS * 1_000_000)
    best = near.groupBy("id").agg(F.min_by(F.struct("forecast_id", "provider"), F.struct(gap, "forecast_id")).alias("f"))
    out = alerts.select("id").join(best, "id", "left").select("id", "f.forecast_id", "f.provider")
    return out.withColumn("verified", F.coalesce(audited(F.col("provider")), F.lit(False)))


def alert_fault(now: Column) -> Column:
    """The first reason why a proposal may not follow its alert, null if there is none. Columns: symbol, side, confidence, model,
    notional of the proposal; alert_symbol, action, expires, verified, alert_confidence, alert_model, suggested, low, high."""
    code = lambda c: F.regexp_replace(F.upper(F.trim(c)), r"^(SH\.)?(SZ\.)?", "")
    wanted = F.when(F.col("action").isin(*BUY), "BUY").when(F.col("action").isin(*SELL), "SELL")
    most = F.abs("suggested")
    against = ((wanted == "BUY") & (F.col("suggested") < 0)) | ((wanted == "SELL") & (F.col("suggested") > 0))
    checks = {
        "symbol": code("symbol") != code("alert_symbol"), "action": wanted.isNull(), "side": F.col("side") != wanted, "expired": F.col("expires") <= now,
        "provider": ~F.col("verified"), "confidence": F.abs(F.col("confidence") - F.col("alert_confidence")) > 1e-9, "model": (F.col("model") != F.col("alert_model")) | (F.col("alert_model") == ""),
        "suggested": finite(most).isNull() | (most <= 0), "direction": against, "target": (finite(F.col("low")) <= 0) | (finite(F.col("high")) <= F.col("low")),
        "notional": F.col("notional") > most * NOTIONAL_SLACK,
    }
    return F.try_element_at(_failed(checks), F.lit(1))


def signal_origin(signals: DataFrame, sessions: DataFrame) -> DataFrame:
    """signals (as_of, created) with origin and status. With an evidence time, its local day must be a session: else the status is
    pending (after the last) or invalid. Without, it is the last session whose bar was complete when the signal was made."""
    by_evidence = F.col("as_of").isNotNull()
    made = local_day(F.col("created"))
    day = F.when(by_evidence, local_day(F.col("as_of"))).when(local_seconds(F.col("created")) >= COMPLETE, made).otherwise(F.date_sub(made, 1))
    d = signals.withColumn("__day", day)
    # the list of days: sessions and days of signals, each with the last session up to it
    known = sessions.select("session").distinct()
    days = d.select(F.col("__day").alias("day")).distinct().join(known.select(F.col("session").alias("day"), "session"), "day", "full")
    w = Window.orderBy("day")
    upto = days.withColumns({"__last": F.last("session", ignorenulls=True).over(w), "__final": F.max("session").over(Window.partitionBy())})
    d = d.join(F.broadcast(upto.select(F.col("day").alias("__day"), "__last", "__final")), "__day", "left")
    exact = F.col("__last") == F.col("__day")
    late = F.col("__final").isNull() | (F.col("__day") > F.col("__final"))
    status = F.when(by_evidence & ~F.coalesce(exact, F.lit(False)), F.when(late, "pending").otherwise("invalid")).when(F.col("__last").isNull(), "pending").otherwise("ok")
    return d.withColumn("status", status).withColumn("origin", F.when(F.col("status") == "ok", F.col("__last"))).drop("__day", "__last", "__final")


def outcome_faults() -> Column:
    """Names of the integrity rules that a stored outcome breaks. Columns: action, change, ret, contribution, hit, origin, maturity,
    created, evaluated, as_of."""
    hit = F.when(F.col("action").isin(*BUY), F.col("ret") > 0).when(F.col("action").isin(*SELL), F.col("ret") < 0)
    return _failed({
        "action": ~F.col("action").isin(*BUY, *SELL, *NEUTRAL), "order": F.col("maturity") <= F.col("origin"), "early": F.col("created") > F.col("evaluated"),
        "immature": F.col("maturity") > local_day(F.col("evaluated")), "evidence": F.col("as_of").isNotNull() & (local_day(F.col("as_of")) != F.col("origin")),
        "return": F.col("ret") <= -1, "change": finite(F.col("change")).isNull() | (F.abs("change") > 1), "contribution": F.abs(F.col("contribution") - F.col("change") * F.col("ret")) > 1e-10,
        "hit": ~F.col("hit").eqNullSafe(hit),
    })


# ---------------------------------------------------------------- rows from brokers and providers


def reconciliation_fault() -> Column:
    """Why a portfolio snapshot (total, cash, market, positions) is refused, null if it is not: the tolerance is 1, or a thousandth of
    the market value."""
    slack = F.greatest(F.lit(1.0), F.col("market") * 0.001)
    bad = (finite(F.col("total")) <= 0) | (finite(F.col("cash")) < 0) | (finite(F.col("market")) < 0)
    return F.try_element_at(_failed({
        "numbers": bad, "cash": F.col("cash") > F.col("total"), "account": F.abs(F.col("cash") + F.col("market") - F.col("total")) > slack,
        "positions": F.abs(F.col("positions") - F.col("market")) > slack,
    }), F.lit(1))


def bar_consistent() -> Column:
    """Whether open, high, low and close are positive and in order, and volume and amount not negative; false for a missing number."""
    inner = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.col("high"))
    signs = (F.least("open", "high", "low", "close") > 0) & (F.least("volume", "amount") >= 0)
    whole = F.forall(F.array("open", "high", "low", "close", "volume", "amount"), lambda x: finite(x).isNotNull())
    return F.coalesce(inner & signs & whole, F.lit(False))


def daily_flows(rows: DataFrame) -> DataFrame:
    """(symbol, day, net, main) from flow rows (symbol, at, net, main, super, big): the last row of a day with a finite net; main is
    the sum of super and big where it is missing."""
    main = F.coalesce(finite(F.col("main")), finite(F.col("super")) + finite(F.col("big")))
    d = rows.select("symbol", F.to_date("at").alias("day"), "at", finite(F.col("net")).alias("net"), main.alias("main")).where("net is not null and day is not null")
    row = F.struct("net", "main")
    return d.groupBy("symbol", "day").agg(F.max_by(row, F.struct("at", row)).alias("r")).select("symbol", "day", "r.*")


def fresh(at: Column, now: Column, most: float) -> Column:
    """Whether a quote's age in seconds is between -5 and most; false for a missing time."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1_000_000
    return F.coalesce((age >= -5) & (age <= most), F.lit(False))


def auto_state(proposals: DataFrame, orders: DataFrame) -> DataFrame:
    """(day, proposals, symbols, submitted) by local day: automatic proposals (symbol, created), their different symbols, and orders
    (status, created) that did not fail and were not cancelled."""
    p = proposals.groupBy(local_day(F.col("created")).alias("day")).agg(F.count("*").alias("proposals"), F.count_distinct("symbol").alias("symbols"))
    o = orders.where(~F.col("status").isin("failed", "cancelled")).groupBy(local_day(F.col("created")).alias("day")).agg(F.count("*").alias("submitted"))
    return p.join(o, "day", "full").na.fill(0, ["proposals", "symbols", "submitted"])


# ---------------------------------------------------------------- verdicts on runs


def evaluation_status(factor: Column, n: Column, live: list[str], excluded: list[str]) -> Column:
    """State of a factor in a window with n periods (null: not evaluated)."""
    state = F.when(n.isNull(), "not_evaluated").when(n > 0, "measured").otherwise("evaluated_no_sample")
    return F.when(factor.isin(*live), "live_only").when(factor.isin(*excluded), "history_excluded_pit_gap").otherwise(state)


def mismatches(fields: list[str], other: str = "other_") -> Column:
    """Names of the fields in which a run and the run beside it (columns with a prefix) differ; two nulls are equal."""
    return F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(other + f)), F.lit(f)) for f in fields)), lambda x: x.isNotNull())


def failed_gates() -> Column:
    """The gates that a run does not pass; it has evidence if there is none. Columns: ic, t, total, benchmark, market, spread."""
    return _failed({
        "positive_significant_ic": ~((F.col("ic") > 0) & (F.col("t") >= 1.96)), "positive_net_return": ~(F.col("total") > 0), "beats_benchmark": ~(F.col("total") > F.col("benchmark")),
        "beats_equal_weight_market": ~(F.col("total") > F.col("market")), "top_layer_beats_bottom": ~(F.col("spread") > 0),
    })


def verdict() -> Column:
    """improved, partial or failed for (ic, t, total, market) out of sample."""
    significant = F.coalesce((F.col("ic") > 0) & (F.abs("t") >= 2), F.lit(False))
    ahead = F.coalesce(F.col("total") > F.col("market"), F.lit(False))
    return F.when(significant & ahead, "improved").when(significant, "partial").otherwise("failed")


def gross_nav(spreads: DataFrame, by: list[str]) -> DataFrame:
    """(by, session, nav) from daily spreads (by, session, spread), starting with 1 a day earlier; missing spreads are skipped, and a
    series with a loss of everything is left out."""
    d = spreads.withColumn("spread", finite(F.col("spread"))).where("spread is not null")
    w = Window.partitionBy(*by)
    d = d.withColumn("__low", F.min("spread").over(w)).where("__low > -1")
    path = F.exp(F.sum(F.log1p("spread")).over(w.orderBy("session").rowsBetween(Window.unboundedPreceding, 0)))
    start = d.groupBy(*by).agg(F.date_sub(F.min("session"), 1).alias("session")).withColumn("nav", F.lit(1.0))
    return d.select(*by, "session", path.alias("nav")).unionByName(start)


# ---------------------------------------------------------------- screens and feeds


def expected_rank(candidates: DataFrame, by: list[str]) -> DataFrame:
    """candidates (expected, score, symbol) with their rank by expected return, then score; missing returns last."""
    w = Window.partitionBy(*by).orderBy(F.col("expected").desc_nulls_last(), F.col("score").desc(), "symbol")
    return candidates.withColumn("rank", F.row_number().over(w))


def latest_expected(forecasts: DataFrame, horizon: int) -> DataFrame:
    """(symbol, expected) of each symbol's newest forecast (symbol, as_of, horizon, expected), where it is finite."""
    newest = forecasts.groupBy("symbol").agg(F.max_by(F.when(F.col("horizon") == horizon, F.col("expected")), F.struct("as_of", F.col("horizon") == horizon)).alias("expected"))
    return newest.select("symbol", finite(F.col("expected")).alias("expected")).where("expected is not null")


def visible_rates(stats: DataFrame, day: Column, cutoff: Column) -> DataFrame:
    """(decile, win_rate) of the newest calibration rows (decile, as_of, updated, samples, win_rate) known at the cutoff."""
    rate = finite(F.col("win_rate"))
    d = stats.where((F.col("as_of") <= day) & (F.col("samples") > 0) & (F.col("updated") <= cutoff) & rate.between(0, 1))
    return d.groupBy("decile").agg(F.max_by("win_rate", F.struct("as_of", "updated", "win_rate")).alias("win_rate"))


def by_day(forecasts: DataFrame, at: Column) -> DataFrame:
    """One row for each symbol and day of evidence: the newest (created, id) known at the instant."""
    row = F.struct(*forecasts.columns)
    known = forecasts.where((F.col("as_of") <= at) & (F.col("created") <= at))
    return known.groupBy("symbol", F.to_date("as_of").alias("day")).agg(F.max_by(row, F.struct("created", "id")).alias("r")).select("day", "r.*")


def recent_negative(events: DataFrame, at: Column, days: int = 3) -> DataFrame:
    """(symbol, id): the newest event (id, symbol, event_type, direction, occurred, ingested) of at most -0.5 in the last days."""
    since = at - F.make_dt_interval(F.lit(days))
    d = events.where((F.col("event_type") != "thesis_shift") & (F.col("direction") <= -0.5) & F.col("occurred").between(since, at) & (F.col("ingested") <= at))
    return d.groupBy("symbol").agg(F.max_by("id", F.struct("occurred", "id")).alias("id"))


def timeline(events: DataFrame, n: int = 10) -> DataFrame:
    """The newest n events (id, occurred, ingested) of each local day that were known by its end, with their rank."""
    d = events.withColumn("day", local_day(F.col("occurred"))).where(local_day(F.col("ingested")) <= F.col("day"))
    w = Window.partitionBy("day").orderBy(F.desc("occurred"), F.desc("id"))
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def canonical_names(names: Column) -> Column:
    """Sorted distinct trimmed names, blank ones left out; null stays null."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")))


def evidence_matches(span: Column, text: Column, exact: bool) -> Column:
    """Whether a span that is not blank occurs in the text, as it is or with all white space taken out of both."""
    bare = F.regexp_replace(span, SPACE, "")
    found = text.contains(span) if exact else F.regexp_replace(text, SPACE, "").contains(bare)
    return F.coalesce((bare != "") & found, F.lit(False))


def allowed_symbols(texts: DataFrame, universe: DataFrame) -> DataFrame:
    """(id, symbols) for texts (id, text, ingested): six-digit codes of the text that are in the universe, and the ingested one."""
    codes = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<!\p{Nd})([0-9]{6})(?!\p{Nd})"), 1)).alias("symbol")).distinct()
    known = codes.join(universe.select("symbol"), "symbol", "left_semi").select("id", "symbol")
    every = known.unionByName(texts.where("ingested is not null").select("id", F.col("ingested").alias("symbol")))
    got = every.groupBy("id").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    return texts.select("id").join(got, "id", "left").select("id", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))


def idempotency_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON (sorted names, nulls kept) of a run's inputs."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def attach_latest(left: DataFrame, flows: DataFrame, on: str) -> DataFrame:
    """left with the columns of the flows (on, session, flow) of the newest session of all; null where a key has none then."""
    newest = flows.agg(F.max("session").alias("session"))  # one row
    return left.join(flows.join(F.broadcast(newest), "session"), on, "left")
