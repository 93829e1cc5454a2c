"""Provenance, integrity, verdicts and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.operators import checks as op
from tidemark.operators import factors as fo
from tidemark.operators import metrics as me
from tidemark.operators import signals as si

from .factors import NAMES, SCORED, price_factors
from .metrics import FWD, NAV, nav, with_future
from .registry import BARS, TICKS, avg_rank, query

def event():
    return F.col("event_id")


def seconds(n):
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def instant(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query(
    "f19_x25_capital_anomalies", "symbol reasons", "direction strength",
    f"""WITH {TICKS}, q AS (SELECT symbol, arg_max(value, event_id) / 25 - 9 AS change, CASE WHEN max(event_id) % 3 > 0 THEN max(event_id) % 23 END AS turnover FROM ticks GROUP BY 1)
    SELECT symbol, concat_ws('+', CASE WHEN abs(change) >= 7 THEN 'price' END, CASE WHEN turnover >= 10 THEN 'turnover' END) AS reasons, greatest(-1, least(1, change / 10)) AS direction,
           greatest(least(1, abs(change) / 10), CASE WHEN turnover IS NULL THEN 0 ELSE least(1, turnover / 20) END) AS strength FROM q WHERE (abs(change) >= 7 OR coalesce(turnover, 0) >= 10) AND symbol::INT % 2 = 0""",
)
def f19(spark, sf):
    t = a.ticks(spark, sf)
    q = t.groupBy("symbol").agg((F.max_by("value", "event_id") / 25 - 9).alias("change"), F.max("event_id").alias("k"))
    q = q.withColumn("turnover", F.when(F.col("k") % 3 > 0, F.col("k") % 23))
    return op.capital_anomalies(q, t.where(F.col("symbol").cast("int") % 2 == 0))


@query(
    "p18_provenance", "id forecast_id provider verified", "",
    f"""WITH {TICKS}, al AS (SELECT event_id AS id, symbol, CASE WHEN event_id % 10 > 0 THEN ts::DATE END AS as_of, ts AS created FROM ticks WHERE event_id % 3 = 0),
    fc AS (SELECT 2 * event_id + i AS id, symbol, ts::DATE AS as_of, ts + to_seconds(CASE WHEN i = 0 THEN event_id % 9 ELSE -(event_id % 13) END) AS created,
                  CASE event_id % 4 WHEN 0 THEN 'exchange' WHEN 1 THEN 'cache-audited:exchange+vendor_b' WHEN 2 THEN 'cache-audited:mock' END AS provider FROM ticks, range(2) r(i)),
    n AS (SELECT al.id, fc.id AS forecast_id, provider FROM al JOIN fc USING (symbol, as_of) WHERE abs(epoch_us(al.created) - epoch_us(fc.created)) <= 5000000
          QUALIFY row_number() OVER (PARTITION BY al.id ORDER BY abs(epoch_us(al.created) - epoch_us(fc.created)), fc.id) = 1)
    SELECT al.id, forecast_id, provider, coalesce(provider IN ('exchange', 'cache-audited:exchange+vendor_b'), false) AS verified FROM al LEFT JOIN n USING (id)""",
)
def p18(spark, sf):
    t = a.ticks(spark, sf)
    alerts = t.where(event() % 3 == 0).select(event().alias("id"), "symbol", F.when(event() % 10 > 0, F.to_date("ts")).alias("as_of"), F.lit("m").alias("model"), F.col("ts").alias("created"))
    k = event() % 4
    provider = F.when(k == 0, "exchange").when(k == 1, "cache-audited:exchange+vendor_b").when(k == 2, "cache-audited:mock")
    both = t.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    shift = F.when(F.col("i") == 0, event() % 9).otherwise(-(event() % 13))
    forecasts = both.select((2 * event() + F.col("i")).alias("id"), "symbol", F.to_date("ts").alias("as_of"), F.lit("m").alias("model"), provider.alias("provider"), (F.col("ts") + seconds(shift)).alias("created"))
    return op.provenance(alerts, forecasts, si.provider_audited)


@query(
    "x15_alert_faults", "event_id fault", "",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'symbol' WHEN event_id % 5 = 4 THEN 'action' WHEN event_id % 7 = 0 THEN 'side' WHEN event_id % 13 = 0 THEN 'expired' WHEN event_id % 17 = 0 THEN 'provider'
    WHEN event_id % 19 = 0 THEN 'confidence' WHEN event_id % 23 = 0 THEN 'model' WHEN event_id % 29 = 0 THEN 'suggested' WHEN event_id % 31 = 0 THEN 'direction' WHEN event_id % 37 = 0 THEN 'target' WHEN value > 105 THEN 'notional' END AS fault FROM events""",
)
def x15(spark, sf):
    e = a.table(spark, sf, "events")
    actions = F.array(*(F.lit(x) for x in ("ADD", "EXIT", "BUY_CANDIDATE", "STOP", "HOLD")))
    buys = (event() % 5).isin(0, 2)
    amount = F.when(buys, 100.0).otherwise(-100.0)
    d = e.select(
        "event_id", F.lit(" sh.000001").alias("symbol"), F.when(event() % 11 == 0, "000002").otherwise("SH.000001").alias("alert_symbol"), F.element_at(actions, (event() % 5 + 1).cast("int")).alias("action"),
        F.when(buys == (event() % 7 != 0), "BUY").otherwise("SELL").alias("side"), F.when(event() % 13 > 0, instant("2024-02-01 00:00:00.000001")).alias("expires"), (event() % 17 > 0).alias("verified"),
        F.lit(0.5).alias("confidence"), F.when(event() % 19 == 0, 0.50001).otherwise(0.5 + 1e-10).alias("alert_confidence"), F.lit("m").alias("model"), F.when(event() % 23 > 0, "m").otherwise("n").alias("alert_model"),
        F.when(event() % 29 == 0, 0.0).when(event() % 31 == 0, -amount).otherwise(amount).alias("suggested"), F.lit(1.0).alias("low"), F.when(event() % 37 == 0, 1.0).otherwise(2.0).alias("high"), F.col("value").alias("notional"),
    )
    return d.withColumn("fault", op.alert_fault(instant("2024-02-01 00:00:00")))


@query(
    "x10_signal_origin", "event_id origin status", "",
    """WITH se AS (SELECT DISTINCT ts::DATE AS session FROM events WHERE day(ts) % 4 > 0 AND day(ts) < 26), k AS (SELECT event_id, event_id % 2 = 0 AS e, ts + INTERVAL 8 HOUR AS l FROM events),
    d AS (SELECT event_id, e, CASE WHEN e OR l::TIME >= TIME '15:06:00' THEN l::DATE ELSE l::DATE - 1 END AS day FROM k), j AS (SELECT d.*, se.session FROM d ASOF LEFT JOIN se ON d.day >= se.session),
    s AS (SELECT *, CASE WHEN e AND (session IS NULL OR session <> day) THEN CASE WHEN day > (SELECT max(session) FROM se) THEN 'pending' ELSE 'invalid' END WHEN session IS NULL THEN 'pending' ELSE 'ok' END AS status FROM j)
    SELECT event_id, CASE WHEN status = 'ok' THEN session END AS origin, status FROM s""",
)
def x10(spark, sf):
    t = a.ticks(spark, sf)
    sessions = t.where((F.dayofmonth("ts") % 4 > 0) & (F.dayofmonth("ts") < 26)).select(F.to_date("ts").alias("session"))
    return op.signal_origin(t.select("event_id", F.when(event() % 2 == 0, F.col("ts")).alias("as_of"), F.col("ts").alias("created")), sessions)


@query(
    "x12_outcome_faults", "event_id faults", "",
    """WITH d AS (SELECT *, (ts + INTERVAL 8 HOUR)::DATE AS l, value / 200 - 1 AS ret, event_id % 5 AS k FROM events)
    SELECT event_id, concat_ws(',', CASE WHEN k = 4 THEN 'action' END, CASE WHEN event_id % 7 = 0 THEN 'order' END, CASE WHEN event_id % 11 = 0 THEN 'early' END, CASE WHEN event_id % 13 = 0 AND event_id % 7 > 0 THEN 'immature' END,
    CASE WHEN event_id % 3 = 0 AND event_id % 6 > 0 THEN 'evidence' END, CASE WHEN ret <= -1 THEN 'return' END, CASE WHEN event_id % 17 = 0 THEN 'change' END, CASE WHEN event_id % 19 = 0 THEN 'contribution' END,
    CASE WHEN (k = 0 AND ret <= 0) OR (k = 1 AND ret >= 0) OR k > 1 THEN 'hit' END) AS faults FROM d""",
)
def x12(spark, sf):
    t = a.ticks(spark, sf)
    day = op.local_day(F.col("ts"))
    actions = F.array(*(F.lit(x) for x in ("ADD", "EXIT", "WATCH", "REVIEW", "OTHER")))
    change = F.when(event() % 17 == 0, 1.5).otherwise(0.1)
    ret = F.col("value") / 200 - 1
    d = t.select(
        "event_id", F.element_at(actions, (event() % 5 + 1).cast("int")).alias("action"), change.alias("change"), ret.alias("ret"), (change * ret + F.when(event() % 19 == 0, 1e-6).otherwise(0.0)).alias("contribution"), F.lit(True).alias("hit"),
        F.date_sub(day, 7).alias("origin"), F.when(event() % 7 == 0, F.date_sub(day, 7)).when(event() % 13 == 0, F.date_add(day, 1)).otherwise(day).alias("maturity"),
        (F.col("ts") + seconds(F.when(event() % 11 == 0, 1).otherwise(-1))).alias("created"), F.col("ts").alias("evaluated"),
        F.when(event() % 3 == 0, F.when(event() % 6 == 0, F.col("ts") - seconds(F.lit(7 * 86400))).otherwise(F.col("ts"))).alias("as_of"),
    )
    return d.withColumn("faults", F.concat_ws(",", op.outcome_faults()))


@query(
    "x26_reconciliation", "event_id fault", "",
    """WITH d AS (SELECT event_id, floor(value) * 100 AS market, CASE WHEN event_id % 5 = 0 THEN -1 ELSE 50 END AS cash, event_id % 4 AS g, event_id % 6 AS h FROM events),
    e AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 10 ELSE market + cash + g END AS total, market + h AS positions, greatest(1, market * 0.001) AS slack FROM d)
    SELECT event_id, CASE WHEN total <= 0 OR cash < 0 THEN 'numbers' WHEN cash > total THEN 'cash' WHEN abs(cash + market - total) > slack THEN 'account' WHEN abs(positions - market) > slack THEN 'positions' END AS fault FROM e""",
)
def x26(spark, sf):
    d = a.table(spark, sf, "events").select("event_id", (F.floor("value") * 100.0).alias("market"), F.when(event() % 5 == 0, -1).otherwise(50).alias("cash"))
    d = d.withColumn("total", F.when(event() % 7 == 0, 10.0).otherwise(F.col("market") + F.col("cash") + event() % 4)).withColumn("positions", F.col("market") + event() % 6)
    return d.withColumn("fault", op.reconciliation_fault())


@query(
    "x27_bar_consistency", "symbol session ok", "",
    f"""WITH {BARS}, d AS (SELECT symbol, session, open, CASE WHEN month(session) = 3 THEN low ELSE high END AS high, CASE WHEN month(session) = 5 THEN NULL ELSE low END AS low, close, CASE WHEN month(session) = 7 THEN -1 ELSE volume END AS volume, amount FROM bars)
    SELECT symbol, session, coalesce(low <= least(open, close) AND high >= greatest(open, close) AND low > 0 AND volume >= 0, false) AS ok FROM d""",
)
def x27(spark, sf):
    m = F.month("session")
    d = a.bars(spark, sf).withColumns({"high": F.when(m == 3, F.col("low")).otherwise(F.col("high")), "volume": F.when(m == 7, -1).otherwise(F.col("volume"))})
    d = d.withColumn("low", F.when(m != 5, F.col("low")))
    return d.withColumn("ok", op.bar_consistent())


@query(
    "x67_daily_flows", "symbol day", "net main",
    f"""WITH {TICKS} SELECT symbol, ts::DATE AS day, value AS net, CASE WHEN event_id % 3 > 0 THEN value / 2 WHEN event_id % 2 = 0 THEN value * 2 + 1 END AS main FROM ticks WHERE event_id % 7 > 0
    QUALIFY row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY ts DESC) = 1""",
)
def x67(spark, sf):
    v = F.col("value")
    rows = a.ticks(spark, sf).select(
        "symbol", F.col("ts").alias("at"), F.when(event() % 7 == 0, "nan").otherwise(v.cast("string")).alias("net"), F.when(event() % 3 > 0, v / 2).alias("main"), (v * 2).alias("super"), F.when(event() % 2 == 0, 1.0).alias("big")
    )
    return op.daily_flows(rows)


@query("x70_fresh_quotes", "event_id ok", "", "SELECT event_id, ts <= TIMESTAMP '2024-01-15 00:00:05' AND ts >= TIMESTAMP '2024-01-14 00:00:00' AS ok FROM events")
def x70(spark, sf):
    return a.ticks(spark, sf).withColumn("ok", op.fresh(F.col("ts"), instant("2024-01-15 00:00:00"), 86400))


@query(
    "x71_auto_state", "day proposals symbols submitted", "",
    f"""WITH {TICKS}, l AS (SELECT *, (ts + INTERVAL 8 HOUR)::DATE AS day FROM ticks), p AS (SELECT day, count(*) AS proposals, count(DISTINCT symbol) AS symbols FROM l WHERE event_type = 'click' AND day(day) > 3 GROUP BY 1),
    o AS (SELECT day, count(*) AS submitted FROM l WHERE event_type = 'view' AND event_id % 3 = 0 GROUP BY 1) SELECT day, coalesce(proposals, 0) AS proposals, coalesce(symbols, 0) AS symbols, coalesce(submitted, 0) AS submitted FROM p FULL JOIN o USING (day)""",
)
def x71(spark, sf):
    t = a.ticks(spark, sf).withColumn("created", F.col("ts"))
    status = F.when(event() % 3 == 0, "filled").when(event() % 3 == 1, "failed").otherwise("cancelled")
    proposals = t.where((F.col("event_type") == "click") & (F.dayofmonth(op.local_day(F.col("ts"))) > 3))
    return op.auto_state(proposals, t.where("event_type = 'view'").withColumn("status", status))


#: Rank ICs of each price factor and session, and the factors that no window has or may have.
LIVE, EXCLUDED = ["live_depth"], ["net_inflow_5d"]
ICS = f"""WITH {SCORED}, fw AS (SELECT symbol, session, lead(px, 1) OVER (PARTITION BY symbol ORDER BY session) / nullif(px, 0) - 1 AS future FROM px),
lg AS ({" UNION ALL ".join(f"SELECT session, symbol, '{f}' AS factor, z_{f} AS z FROM zs WHERE z_{f} IS NOT NULL" for f in NAMES)}),
rk AS (SELECT *, {avg_rank("z", "factor, session")} AS ra, {avg_rank("future", "factor, session")} AS rb FROM (SELECT factor, session, z, future FROM lg JOIN fw USING (symbol, session) WHERE future IS NOT NULL)),
ic AS (SELECT factor, session, CASE WHEN count(*) >= 2 AND stddev_pop(ra) > 1e-12 AND stddev_pop(rb) > 1e-12 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END AS ic FROM rk GROUP BY ALL)"""


@query(
    "x48_evaluation_status", "factor year n status", "",
    f"""{ICS}, g AS (SELECT factor, year FROM (VALUES {", ".join(f"('{f}')" for f in [*NAMES, *LIVE, *EXCLUDED])}) f(factor), (SELECT DISTINCT year(session) AS year FROM bars)),
    n AS (SELECT factor, year(session) AS year, count(ic) AS n FROM ic GROUP BY ALL)
    SELECT factor, year, n, CASE WHEN factor = '{LIVE[0]}' THEN 'live_only' WHEN factor = '{EXCLUDED[0]}' THEN 'history_excluded_pit_gap' WHEN n IS NULL THEN 'not_evaluated' WHEN n > 0 THEN 'measured' ELSE 'evaluated_no_sample' END AS status FROM g LEFT JOIN n USING (factor, year)""",
)
def x48(spark, sf):
    b = a.bars(spark, sf)
    z = fo.standardise(price_factors(spark, sf), NAMES, ["session"])
    long = z.select("session", "symbol", F.expr(f"stack({len(NAMES)}, {', '.join(f"'{f}', z_{f}" for f in NAMES)}) as (factor, z)"))
    ic = me.rank_ic(long.join(me.forward_returns(fo.adjusted(b, a.adjustments(b)), (1,)), ["symbol", "session"]), "z", "future", ["factor", "session"])
    years = b.select(F.year("session").alias("year")).distinct()
    grid = years.withColumn("factor", F.explode(F.array(*map(F.lit, [*NAMES, *LIVE, *EXCLUDED]))))
    d = grid.join(ic.groupBy("factor", F.year("session").alias("year")).agg(F.count("ic").alias("n")), ["factor", "year"], "left")
    return d.withColumn("status", op.evaluation_status(F.col("factor"), F.col("n"), LIVE, EXCLUDED))


@query(
    "x51_protocol_mismatch", "horizon first last fields", "",
    f"""WITH {FWD}, p AS (SELECT horizon, min(session) AS first, max(session) AS last, count(DISTINCT session) AS sessions, count(DISTINCT symbol) AS symbols FROM sf GROUP BY 1)
    SELECT p.horizon, p.first, p.last, concat_ws(',', CASE WHEN p.first IS DISTINCT FROM o.first THEN 'first' END, CASE WHEN p.last IS DISTINCT FROM o.last THEN 'last' END, CASE WHEN p.sessions <> o.sessions THEN 'sessions' END,
      CASE WHEN p.symbols <> o.symbols THEN 'symbols' END) AS fields FROM p JOIN p o ON o.horizon = 1""",
)
def x51(spark, sf):
    names = ["first", "last", "sessions", "symbols"]
    f = with_future(spark, sf).where("score is not null and future is not null")
    runs = f.groupBy("horizon").agg(F.min("session").alias("first"), F.max("session").alias("last"), F.countDistinct("session").alias("sessions"), F.countDistinct("symbol").alias("symbols"))
    first = runs.where("horizon = 1").select(*(F.col(n).alias(f"other_{n}") for n in names))
    return runs.crossJoin(F.broadcast(first)).withColumn("fields", F.concat_ws(",", op.mismatches(names)))  # one row


@query(
    "f37_run_verdicts", "horizon failed verdict", "ic t total market benchmark spread",
    f"""WITH {FWD}, s AS (SELECT horizon, avg(ic) AS ic, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*)) AS t FROM ic WHERE ic IS NOT NULL GROUP BY 1),
    li AS (SELECT *, row_number() OVER (PARTITION BY horizon, session ORDER BY score, symbol) - 1 AS i, count(*) OVER (PARTITION BY horizon, session) AS n FROM sf),
    la AS (SELECT horizon, session, (CASE WHEN n = 1 THEN 9 ELSE least(9, i * 10 // (n - 1)) END)::INTEGER AS layer, avg(future) AS ret FROM li GROUP BY ALL),
    tb AS (SELECT horizon, avg(top) AS total, avg(top - bottom) AS spread FROM (SELECT horizon, session, arg_max(ret, layer) AS top, arg_min(ret, layer) AS bottom FROM la GROUP BY ALL) GROUP BY 1),
    mk AS (SELECT horizon, avg(m) AS market FROM (SELECT horizon, session, avg(future) AS m FROM sf GROUP BY ALL) GROUP BY 1), be AS (SELECT horizon, avg(future) AS benchmark FROM sf WHERE symbol = '000001' GROUP BY 1),
    d AS (SELECT * FROM s JOIN tb USING (horizon) JOIN mk USING (horizon) LEFT JOIN be USING (horizon))
    SELECT *, concat_ws(',', CASE WHEN NOT coalesce(ic > 0 AND t >= 1.96, false) THEN 'positive_significant_ic' END, CASE WHEN NOT coalesce(total > 0, false) THEN 'positive_net_return' END, CASE WHEN NOT coalesce(total > benchmark, false) THEN 'beats_benchmark' END,
      CASE WHEN NOT coalesce(total > market, false) THEN 'beats_equal_weight_market' END, CASE WHEN NOT coalesce(spread > 0, false) THEN 'top_layer_beats_bottom' END) AS failed,
    CASE WHEN ic > 0 AND abs(t) >= 2 THEN CASE WHEN total > market THEN 'improved' ELSE 'partial' END ELSE 'failed' END AS verdict FROM d""",
)
def f37(spark, sf):
    f = with_future(spark, sf).where("score is not null and future is not null")
    by = ["horizon", "session"]
    stats = me.ic_summary(me.rank_ic(f, "score", "future", by), ["horizon"]).select("horizon", F.col("mean").alias("ic"), "t")
    lay = me.layers(f, "score", "future", by).groupBy(*by).agg(F.max_by("ret", "layer").alias("top"), F.min_by("ret", "layer").alias("bottom"))
    total = lay.groupBy("horizon").agg(F.avg("top").alias("total"), F.avg(F.col("top") - F.col("bottom")).alias("spread"))
    market = f.groupBy(*by).agg(F.avg("future").alias("m")).groupBy("horizon").agg(F.avg("m").alias("market"))
    bench = f.where("symbol = '000001'").groupBy("horizon").agg(F.avg("future").alias("benchmark"))
    d = stats.join(total, "horizon").join(market, "horizon").join(bench, "horizon", "left")
    return d.withColumns({"failed": F.concat_ws(",", op.failed_gates()), "verdict": op.verdict()})


@query(
    "x56_gross_long_short", "book n", "total annual volatility drawdown",
    f"""WITH {NAV}, s AS (SELECT book, session, (nav - 103) / 400 AS spread FROM daynav WHERE day(session) % 9 > 0),
    p AS (SELECT book, session, exp(sum(ln(1 + spread)) OVER (PARTITION BY book ORDER BY session)) AS nav FROM s UNION ALL SELECT book, min(session) - 1, 1 FROM s GROUP BY 1),
    d AS (SELECT *, nav / lag(nav) OVER w - 1 AS r, nav / max(nav) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM p WINDOW w AS (PARTITION BY book ORDER BY session)),
    g AS (SELECT book, count(*) AS n, arg_max(nav, session) - 1 AS total, stddev_samp(r) * sqrt(252) AS volatility, min(dd) AS drawdown FROM d GROUP BY 1) SELECT *, pow(1 + total, 252.0::DOUBLE / (n - 1)) - 1 AS annual FROM g""",
)
def x56(spark, sf):
    d = nav(spark, sf).withColumn("spread", F.when(F.dayofmonth("session") % 9 > 0, (F.col("nav") - 103) / 400))
    return me.nav_performance(op.gross_nav(d, ["book"]), ["book"])


@query(
    "k4_j16_expected_rank", "symbol rank", "expected score",
    f"""WITH {TICKS}, f AS (SELECT symbol, ts::DATE AS as_of, (event_id % 3)::INT AS h, max(value) AS expected FROM ticks GROUP BY ALL), n AS (SELECT symbol, expected FROM f WHERE h = 1 AND as_of = (SELECT max(as_of) FROM f g WHERE g.symbol = f.symbol) AND expected < 400),
    c AS (SELECT symbol, count(*) AS score FROM ticks GROUP BY 1) SELECT symbol, expected, score, row_number() OVER (ORDER BY expected DESC NULLS LAST, score DESC, symbol)::INT AS rank FROM c LEFT JOIN n USING (symbol)""",
)
def k4(spark, sf):
    t = a.ticks(spark, sf)
    f = t.groupBy("symbol", F.to_date("ts").alias("as_of"), (event() % 3).alias("horizon")).agg(F.max("value").alias("v"))
    f = f.withColumn("expected", F.when(F.col("v") < 400, F.col("v")).otherwise(F.lit(float("inf"))))
    c = t.groupBy("symbol").agg(F.count("*").alias("score")).withColumn("run", F.lit(1))
    return op.expected_rank(c.join(op.latest_expected(f, 1), "symbol", "left"), ["run"])


@query(
    "x62_x66_win_rates", "p_partkey", "score win_rate",
    f"""WITH {TICKS}, v AS (SELECT event_id % 10 + 1 AS decile, ts::DATE AS as_of, ts + INTERVAL 6 HOUR AS updated, value / 400 AS win_rate FROM ticks WHERE event_id % 4 > 0),
    r AS (SELECT decile, win_rate FROM v WHERE as_of <= DATE '2024-01-15' AND updated <= TIMESTAMP '2024-01-15 11:30:00' AND win_rate <= 1 QUALIFY row_number() OVER (PARTITION BY decile ORDER BY as_of DESC, updated DESC) = 1),
    s AS (SELECT p_partkey, p_partkey % 101 AS score, least(floor(p_partkey % 101 / 10) + 1, 10) AS decile FROM part) SELECT p_partkey, score, win_rate FROM s LEFT JOIN r USING (decile)""",
)
def x62(spark, sf):
    t = a.ticks(spark, sf).select((event() % 10 + 1).alias("decile"), F.to_date("ts").alias("as_of"), (F.col("ts") + seconds(F.lit(6 * 3600))).alias("updated"), (event() % 4).alias("samples"), (F.col("value") / 400).alias("win_rate"))
    rates = op.visible_rates(t, F.lit("2024-01-15").cast("date"), instant("2024-01-15 11:30:00"))
    scores = a.table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 101).alias("score"))
    return scores.withColumn("decile", fo.decile(F.col("score"))).join(F.broadcast(rates), "decile", "left")  # ten rows at most


@query(
    "x6_forecasts_by_day", "symbol day id", "",
    f"WITH {TICKS} SELECT symbol, ts::DATE AS day, event_id AS id FROM ticks WHERE ts + to_seconds(event_id % 5 * 7200) <= TIMESTAMP '2024-01-20 12:00:00' QUALIFY row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY ts + to_seconds(event_id % 5 * 7200) DESC, event_id DESC) = 1",
)
def x6(spark, sf):
    f = a.ticks(spark, sf).select(event().alias("id"), "symbol", F.col("ts").alias("as_of"), (F.col("ts") + seconds(event() % 5 * 7200)).alias("created"))
    return op.by_day(f, instant("2024-01-20 12:00:00"))


def domain_events(spark, sf):
    """Ticks as events, known up to nine hours later."""
    kind = F.when(F.col("event_type") == "error", "thesis_shift").otherwise(F.col("event_type"))
    return a.ticks(spark, sf).select(event().alias("id"), "symbol", kind.alias("event_type"), (F.col("value") / 100 - 1).alias("direction"), F.col("ts").alias("occurred"), (F.col("ts") + seconds(event() % 4 * 10800)).alias("ingested"))


@query(
    "x7_recent_negative", "symbol id", "",
    f"""WITH {TICKS} SELECT symbol, arg_max(event_id, ts) AS id FROM ticks WHERE event_type <> 'error' AND value / 100 - 1 <= -0.5 AND ts BETWEEN TIMESTAMP '2024-01-17 12:00:00' AND TIMESTAMP '2024-01-20 12:00:00'
    AND ts + to_seconds(event_id % 4 * 10800) <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1""",
)
def x7(spark, sf):
    return op.recent_negative(domain_events(spark, sf), instant("2024-01-20 12:00:00"))


@query(
    "x30_event_timeline", "day rank id", "",
    f"""WITH {TICKS}, d AS (SELECT event_id AS id, ts, (ts + INTERVAL 8 HOUR)::DATE AS day, (ts + to_seconds(event_id % 4 * 10800) + INTERVAL 8 HOUR)::DATE AS seen FROM ticks)
    SELECT day, id, row_number() OVER (PARTITION BY day ORDER BY ts DESC, id DESC)::INT AS rank FROM d WHERE seen <= day QUALIFY row_number() OVER (PARTITION BY day ORDER BY ts DESC, id DESC) <= 10""",
)
def x30(spark, sf):
    return op.timeline(domain_events(spark, sf))


@query(
    "x31_x59_filter_keys", "event_id names key", "",
    """WITH d AS (SELECT event_id, CASE WHEN event_type < 'b' THEN event_type || '","b' WHEN event_type > 'b' THEN 'b","' || event_type ELSE 'b' END AS q FROM events)
    SELECT event_id, replace(q, '","', ',') AS names, sha256('{"industries":["' || q || '"],"style":null,"top_n":' || event_id % 3 || '}') AS key FROM d""",
)
def x31(spark, sf):
    t = F.col("event_type")
    d = a.table(spark, sf, "events").withColumn("n", op.canonical_names(F.array(F.lit("b "), t, F.concat(F.lit(" "), t), F.lit("  "), F.lit("b"))))
    key = op.idempotency_key({"top_n": event() % 3, "industries": F.col("n"), "style": F.lit(None).cast("string")})
    return d.select("event_id", F.concat_ws(",", "n").alias("names"), key.alias("key"))


SPAN = "substring(text, 5, 10) || ' ' || substring(text, 15, 10)"


@query(
    "f29_evidence_spans", "doc_id exact loose", "",
    f"""WITH d AS (SELECT doc_id, text, {SPAN} AS span FROM documents), e AS (SELECT *, regexp_replace(span, '{op.SPACE}', '', 'g') AS bare FROM d)
    SELECT doc_id, coalesce(bare <> '' AND contains(text, span), false) AS exact, coalesce(bare <> '' AND contains(regexp_replace(text, '{op.SPACE}', '', 'g'), bare), false) AS loose FROM e""",
)
def f29(spark, sf):
    d = a.table(spark, sf, "documents").withColumn("span", F.concat(F.substring("text", 5, 10), F.lit(" "), F.substring("text", 15, 10)))
    return d.withColumns({k: op.evidence_matches(F.col("span"), F.col("text"), k == "exact") for k in ("exact", "loose")})


@query(
    "f30_allowed_symbols", "doc_id symbols", "",
    """WITH u AS (SELECT DISTINCT lpad(s_suppkey::VARCHAR, 6, '0') AS symbol FROM supplier), t AS (SELECT doc_id, coalesce(text, '') || ' ' || lpad((doc_id % 300)::VARCHAR, 6, '0') || ',0000007' AS text, CASE WHEN doc_id % 5 = 0 THEN lpad((doc_id % 7)::VARCHAR, 6, '0') END AS ingested FROM documents),
    c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{Nd}+')) AS symbol FROM t), k AS (SELECT doc_id, symbol FROM c SEMI JOIN u USING (symbol) UNION SELECT doc_id, ingested FROM t WHERE ingested IS NOT NULL)
    SELECT doc_id, coalesce((SELECT string_agg(symbol, ',' ORDER BY symbol) FROM k WHERE k.doc_id = t.doc_id), '') AS symbols FROM t""",
)
def f30(spark, sf):
    k = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.lpad((k % 300).cast("string"), 6, "0"), F.lit(",0000007"))
    t = a.table(spark, sf, "documents").select(k.alias("id"), text.alias("text"), F.when(k % 5 == 0, F.lpad((k % 7).cast("string"), 6, "0")).alias("ingested"))
    u = a.table(spark, sf, "supplier").select(a.symbol("s_suppkey").alias("symbol"))
    return op.allowed_symbols(t, u).select(F.col("id").alias("doc_id"), F.array_join("symbols", ",").alias("symbols"))


@query(
    "x34_latest_flows", "plate session", "flow",
    f"""WITH {BARS}, p AS (SELECT printf('N%02d', s_nationkey) AS plate, lpad(s_suppkey::VARCHAR, 6, '0') AS symbol FROM supplier),
    f AS (SELECT plate, session, sum(CASE WHEN close >= open THEN amount ELSE -amount END) AS flow FROM bars JOIN p USING (symbol) WHERE plate <> 'N07' GROUP BY 1, 2)
    SELECT plate, session, flow FROM (SELECT DISTINCT plate FROM p) LEFT JOIN (SELECT * FROM f WHERE session = (SELECT max(session) FROM f)) USING (plate)""",
)
def x34(spark, sf):
    return op.attach_latest(a.plates(spark, sf).select("plate").distinct(), a.flows(spark, sf), "plate")
