"""Factor cross-sections, scores, technical features, forecasts; point-in-time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.functions.clean import board, exchange_suffix, limit_price, limit_ratio, six_digits
from tidemark.operators import factors as op
from tidemark.operators import pit

from .registry import ADJ, BARS, DAILY, FACTORS, FIN, PX, VAL, avg_rank, query, scaled

WEIGHTS = {"momentum_short": 0.5, "momentum_long": 0.2, "volatility": -0.2, "turnover_change": 0.1}
NAMES = list(WEIGHTS)


def price_factors(spark: SparkSession, sf: str) -> DataFrame:
    b = a.bars(spark, sf)
    return op.price_factors(b, a.adjustments(b))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return op.composite(op.standardise(price_factors(spark, sf), NAMES, ["session"]), WEIGHTS, ["session"])


def winsor_sql(f: str) -> str:
    c = f"CASE WHEN {f} IS NOT NULL THEN least(greatest({f}, q_{f}[1]), q_{f}[2]) END"
    return f"{c} AS c_{f}"


Z_SQL = f"""
qs AS (SELECT session, {", ".join(f"quantile_cont({f}, [0.025, 0.975]) AS q_{f}" for f in NAMES)} FROM pf GROUP BY session),
cl AS (SELECT pf.*, {", ".join(winsor_sql(f) for f in NAMES)} FROM pf JOIN qs USING (session)),
zs AS (SELECT *, {", ".join(f"CASE WHEN c_{f} IS NULL THEN NULL WHEN stddev_pop(c_{f}) OVER w <= 1e-8 THEN 0 ELSE (c_{f} - avg(c_{f}) OVER w) / stddev_pop(c_{f}) OVER w END AS z_{f}" for f in NAMES)}
       FROM cl WINDOW w AS (PARTITION BY session)),
raws AS (SELECT *, round(({" + ".join(f"coalesce(z_{f}, 0) * {v}" for f, v in WEIGHTS.items())})
               / nullif({" + ".join(f"CASE WHEN count(z_{f}) OVER w > 0 THEN {abs(v)}::DOUBLE ELSE 0 END" for f, v in WEIGHTS.items())}, 0), 9) AS raw
         FROM zs WINDOW w AS (PARTITION BY session)),
sc AS (SELECT *, {scaled("raw", "session")} AS score FROM raws)"""
SCORED = f"{FACTORS}, {Z_SQL}"


@query("w1_w2_w3_price_factors", "symbol session", " ".join(NAMES), f"WITH {FACTORS} SELECT * FROM pf")
def w1(spark, sf):
    return price_factors(spark, sf)


@query("w4_daily_returns", "symbol session", "ret", f"WITH {BARS}, {ADJ}, {PX} SELECT symbol, session, px / nullif(lag(px) OVER (PARTITION BY symbol ORDER BY session), 0) - 1 AS ret FROM px")
def w4(spark, sf):
    b = a.bars(spark, sf)
    return op.daily_returns(b, a.adjustments(b))


@query("j2_adjusted_bars", "symbol session degraded", "px", f"WITH {BARS}, {ADJ}, {PX} SELECT * FROM px")
def j2(spark, sf):
    b = a.bars(spark, sf)
    return op.adjusted(b, a.adjustments(b))


@query("j3_execution_prices", "symbol session", "px", f"WITH {BARS}, {ADJ} SELECT symbol, session, open * adj_factor AS px FROM bars JOIN adj USING (symbol, session) WHERE adj_factor > 0")
def j3(spark, sf):
    b = a.bars(spark, sf)
    return b.join(a.adjustments(b).where("adj_factor > 0"), ["symbol", "session"]).withColumn("px", F.col("open") * F.col("adj_factor"))


@query("w12_winsor_zscores", "symbol session", " ".join(f"z_{f}" for f in NAMES), f"WITH {SCORED} SELECT * FROM zs")
def w12(spark, sf):
    return op.standardise(price_factors(spark, sf), NAMES, ["session"])


@query("w14_composite_score", "symbol session", "raw score", f"WITH {SCORED} SELECT * FROM sc")
def w14(spark, sf):
    return scored(spark, sf)


@query(
    "k1_target_portfolio", "symbol session rank", "score",
    f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol)::INTEGER AS rank, count(*) OVER (PARTITION BY session) AS n FROM sc WHERE score IS NOT NULL) SELECT * FROM r WHERE rank <= ceil(n * 0.1)",
)
def k1(spark, sf):
    return op.target_portfolio(scored(spark, sf), "score", ["session"], 0.1)


@query(
    "f7_five_dimensions", "symbol session", "technical capital fundamental valuation sentiment five_dim",
    f"""WITH {SCORED}, d AS (SELECT symbol, session,
        5 + 2 * (coalesce(z_momentum_short, 0) + coalesce(z_momentum_long, 0)) / 2 AS t,
        5 + 2 * coalesce(z_volatility, 0) AS c, 5 + 2 * (coalesce(z_momentum_long, 0) + 0) / 2 AS f, 5 - 2 * coalesce(z_volatility, 0) AS v, 5 + 2 * coalesce(z_turnover_change, 0) AS s FROM zs),
        e AS (SELECT symbol, session, least(greatest(t, 0), 10) AS technical, least(greatest(c, 0), 10) AS capital, least(greatest(f, 0), 10) AS fundamental, least(greatest(v, 0), 10) AS valuation, least(greatest(s, 0), 10) AS sentiment FROM d)
        SELECT *, .25 * technical + .2 * capital + .25 * fundamental + .15 * valuation + .15 * sentiment AS five_dim FROM e""",
)
def f7(spark, sf):
    z = op.standardise(price_factors(spark, sf), NAMES, ["session"])
    null = F.lit(None).cast("double")
    return op.five_dimensions(z.withColumns({"z_net_inflow": F.col("z_volatility"), "z_roe": F.col("z_momentum_long"), "z_profit": null, "z_pe": F.col("z_volatility")}))


TECH_SQL = f"""{BARS},
t0 AS (SELECT *, row_number() OVER w AS bar, close / nullif(lag(close) OVER w, 0) - 1 AS ret, nullif(volume, 0) AS vol_ok FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session)),
t1 AS (SELECT symbol, session, bar::INTEGER AS bar,
  {", ".join(f"coalesce(close / nullif(lag(close, {n}) OVER w, 0) - 1, 0) AS mom_{n}" for n in (1, 5, 20, 60))},
  avg(close) OVER (w ROWS 4 PRECEDING) / avg(close) OVER (w ROWS 19 PRECEDING) - 1 AS gap_5_20, avg(close) OVER (w ROWS 19 PRECEDING) / avg(close) OVER (w ROWS 59 PRECEDING) - 1 AS gap_20_60,
  coalesce(stddev_pop(ret) OVER (w ROWS 19 PRECEDING) * sqrt(252), 0) AS vol_20, close / max(close) OVER (w ROWS 59 PRECEDING) - 1 AS drawdown,
  CASE WHEN max(close) OVER (w ROWS 59 PRECEDING) > min(close) OVER (w ROWS 59 PRECEDING) THEN (close - min(close) OVER (w ROWS 59 PRECEDING)) / (max(close) OVER (w ROWS 59 PRECEDING) - min(close) OVER (w ROWS 59 PRECEDING)) ELSE 0.5 END AS position,
  1.0 AS completeness, coalesce(avg(vol_ok) OVER (w ROWS 4 PRECEDING) / avg(vol_ok) OVER (w ROWS 19 PRECEDING), 1) AS volume_ratio
  FROM t0 WINDOW w AS (PARTITION BY symbol ORDER BY session)),
tech AS (SELECT * FROM t1 WHERE bar >= 30)"""
FORE_SQL = f"""{TECH_SQL},
h0 AS (SELECT *, unnest([1, 5, 20])::INTEGER AS horizon FROM tech),
h1 AS (SELECT *, sqrt(horizon / 20.0::DOUBLE) AS root, sqrt(horizon / 252.0::DOUBLE) AS sc FROM h0),
h2 AS (SELECT *, 4 * mom_20 * least(1, root) + 2 * mom_5 + 2.5 * gap_5_20 + 1.5 * gap_20_60 + 0.35 * (volume_ratio - 1) + 0.8 * (position - 0.5) - 0.55 * vol_20 + 0.5 * drawdown AS z,
   least(greatest(0.32 * mom_20 * root + 0.10 * mom_5 + 0.12 * gap_5_20 - 0.03 * vol_20 * sc, -0.35), 0.35) AS expected, greatest(0.005, vol_20 * sc) AS sd FROM h1),
fore0 AS (SELECT *, least(greatest(1 / (1 + exp(-least(greatest(z, -20), 20))), 0.05), 0.95) AS p_up FROM h2),
fore AS (SELECT *, expected - 1.2816 * sd AS q10, expected + 1.2816 * sd AS q90, least(greatest(0.35 + 0.65 * abs(p_up - 0.5) + 0.20 * completeness - 0.15 * least(vol_20, 1), 0.2), 0.82) AS confidence, bar < 120 AS warning FROM fore0)"""
TECH = "mom_1 mom_5 mom_20 mom_60 gap_5_20 gap_20_60 vol_20 drawdown position completeness volume_ratio"


@query("w5_technical_features", "symbol session bar", TECH, f"WITH {TECH_SQL} SELECT * FROM tech")
def w5(spark, sf):
    return op.technical(a.bars(spark, sf))


@query("f2_f3_forecasts", "symbol session horizon warning", "p_up expected q10 q90 confidence", f"WITH {FORE_SQL} SELECT * FROM fore")
def f2(spark, sf):
    return op.forecasts(op.technical(a.bars(spark, sf)))


@query(
    "f4_regime", "symbol session regime", "regime_confidence",
    f"""WITH {TECH_SQL} SELECT symbol, session,
    CASE WHEN vol_20 > .5 AND abs(mom_1) > .035 THEN 'EVENT_SHOCK' WHEN mom_20 > .05 AND mom_60 > .08 AND drawdown > -.06 THEN 'TREND_UP' WHEN mom_20 < -.05 AND mom_60 < -.08 THEN 'TREND_DOWN'
         WHEN mom_20 > .02 AND position > .65 THEN 'RISK_ON' WHEN drawdown < -.12 OR vol_20 > .42 THEN 'RISK_OFF' ELSE 'RANGE' END AS regime,
    CASE WHEN vol_20 > .5 AND abs(mom_1) > .035 THEN least(.9, .55 + .3 * vol_20) WHEN mom_20 > .05 AND mom_60 > .08 AND drawdown > -.06 THEN .55 + least(.3, .8 * (mom_20 + mom_60))
         WHEN mom_20 < -.05 AND mom_60 < -.08 THEN .55 + least(.3, .8 * abs(mom_20 + mom_60)) WHEN mom_20 > .02 AND position > .65 THEN .58 WHEN drawdown < -.12 OR vol_20 > .42 THEN .62
         ELSE .52 + least(.15, 2 * abs(mom_20)) END AS regime_confidence FROM tech""",
)
def f4(spark, sf):
    return op.regime(op.technical(a.bars(spark, sf)))


WIDE_SQL = f"""{FORE_SQL}, wide AS (SELECT symbol, session, max(vol_20) AS vol_20, max(CASE WHEN horizon = 5 THEN p_up END) AS p5, max(CASE WHEN horizon = 20 THEN p_up END) AS p20, max(CASE WHEN horizon = 20 THEN confidence END) AS conf20,
   max(CASE WHEN horizon = 20 THEN q10 END) AS q10, max(CASE WHEN horizon = 20 THEN q90 END) AS q90, max(CASE WHEN horizon = 20 THEN expected END) AS expected FROM fore GROUP BY ALL),
alerts AS (SELECT *, CASE WHEN p20 >= .68 AND p5 >= .60 AND conf20 >= .55 THEN 'BUY_CANDIDATE' WHEN p20 <= .35 OR p5 <= .38 THEN 'REDUCE' WHEN conf20 < .35 THEN 'REVIEW_REQUIRED' WHEN p20 >= .56 THEN 'WATCH' ELSE 'HOLD' END AS action FROM wide),
alert AS (SELECT *, CASE action WHEN 'BUY_CANDIDATE' THEN .10 WHEN 'REDUCE' THEN -.25 ELSE 0 END AS position_change FROM alerts)"""


def wide(spark, sf) -> DataFrame:
    f = op.forecasts(op.technical(a.bars(spark, sf)))

    def at(h: int, c: str):
        return F.max(F.when(F.col("horizon") == h, F.col(c)))

    return f.groupBy("symbol", "session").agg(
        F.max("vol_20").alias("vol_20"), at(5, "p_up").alias("p5"), at(20, "p_up").alias("p20"), at(20, "confidence").alias("conf20"),
        at(20, "q10").alias("q10"), at(20, "q90").alias("q90"), at(20, "expected").alias("expected"),
    )


@query("f5_alert_actions", "symbol session action", "position_change p5 p20 conf20", f"WITH {WIDE_SQL} SELECT * FROM alert")
def f5(spark, sf):
    return op.alerts(wide(spark, sf))


@query(
    "f16_k5_baseline_screen", "session symbol rank", "screen",
    f"""WITH {WIDE_SQL}, s AS (SELECT *, .60 * least(greatest(50 + (p20 - .5) * 150, 0), 100) + .25 * least(greatest(100 - 110 * vol_20, 0), 100) + .15 * 50 AS screen FROM wide),
    r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY screen DESC, symbol)::INTEGER AS rank FROM s) SELECT * FROM r WHERE rank <= 20""",
)
def k5(spark, sf):
    s = wide(spark, sf).withColumn("screen", op.screen_score(F.col("p20"), F.col("vol_20")))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("screen"), "symbol"))).where("rank <= 20")


@query(
    "f17_target_band", "symbol session", "target_low target_high notional",
    f"""WITH {WIDE_SQL} SELECT symbol, session, close * (1 + q10) AS target_low, close * (1 + q90) AS target_high,
        1000000 * abs(position_change) * least(1, .3 / nullif(vol_20, 0)) * sign(position_change) AS notional FROM alert JOIN bars USING (symbol, session)""",
)
def f17(spark, sf):
    j = op.alerts(wide(spark, sf)).join(a.bars(spark, sf).select("symbol", "session", "close"), ["symbol", "session"])
    size = 1_000_000 * F.abs("position_change") * F.least(F.lit(1.0), F.try_divide(F.lit(0.3), F.col("vol_20"))) * F.signum("position_change")
    return j.withColumns({"target_low": F.col("close") * (1 + F.col("q10")), "target_high": F.col("close") * (1 + F.col("q90")), "notional": size})


@query(
    "w13_valuation_percentiles", "symbol nation", "pe_pct pb_pct",
    f"""WITH {VAL}, v AS (SELECT *, CASE WHEN pe > 0 THEN pe END AS pe1, CASE WHEN pb > 0 THEN pb END AS pb1 FROM val)
    SELECT symbol, nation, ({avg_rank("pe1", "nation")}) / count(pe1) OVER (PARTITION BY nation) AS pe_pct, ({avg_rank("pb1", "nation")}) / count(pb1) OVER (PARTITION BY nation) AS pb_pct FROM v""",
)
def w13(spark, sf):
    return op.valuation_ranks(op.valuation_ranks(a.valuations(spark, sf), "pe", ["nation"], "pe_pct"), "pb", ["nation"], "pb_pct")


CUT = "1998-06-30"


@query(
    "j5_latest_period", "symbol metric period", "value",
    f"WITH {FIN} SELECT symbol, metric, max(period) AS period, arg_max(value, period) AS value FROM fin WHERE available <= DATE '{CUT}' AND value IS NOT NULL GROUP BY ALL",
)
def j5(spark, sf):
    return pit.latest_period(a.financials(spark, sf), F.lit(CUT).cast("date"))


@query(
    "f22_year_on_year", "symbol period", "revenue yoy",
    f"""WITH {FIN}, r AS (SELECT symbol, period, value, left(period, 4)::INT * 4 + right(period, 1)::INT AS q FROM fin WHERE metric = 'revenue')
    SELECT n.symbol, n.period, n.value AS revenue, (n.value - p.value) / nullif(abs(p.value), 0) AS yoy FROM r n LEFT JOIN r p ON p.symbol = n.symbol AND p.q = n.q - 4""",
)
def f22(spark, sf):
    return pit.year_on_year(a.financials(spark, sf).where("metric = 'revenue'")).withColumnRenamed("value", "revenue")


@query(
    "j6_asof_adjustment_events", "symbol session", "factor",
    f"""WITH {DAILY}, ev AS (SELECT DISTINCT symbol, date_trunc('year', session)::DATE + 40 AS event_date, (year(session) - 1990) / 10.0::DOUBLE AS factor FROM daily)
    SELECT d.symbol, d.session, e.factor FROM daily d ASOF LEFT JOIN ev e ON d.symbol = e.symbol AND d.session >= e.event_date""",
)
def j6(spark, sf):
    d = a.daily_bars(spark, sf)
    events = d.select("symbol", F.date_add(F.trunc("session", "year"), 40).alias("event_date"), ((F.year("session") - 1990) / 10.0).alias("factor")).distinct()
    return pit.asof_backward(d.select("symbol", "session"), events, ["symbol"], "session", "event_date", "factor")


@query(
    "p13_tradable_at_open", "symbol session buy_ok sell_ok", "reference",
    f"""WITH {BARS}, {ADJ}, j AS (SELECT b.*, a.adj_factor, lag({{'c': close, 'f': a.adj_factor}}) OVER (PARTITION BY symbol ORDER BY session) AS prev FROM bars b LEFT JOIN adj a USING (symbol, session)),
    r AS (SELECT *, prev.c * prev.f / adj_factor AS reference, open > 0 AND volume > 0 AND adj_factor > 0 AND prev.c * prev.f / adj_factor IS NOT NULL AS ok,
       CASE WHEN substr(symbol, 6, 1) IN ('3', '6') THEN .2::DOUBLE ELSE .1::DOUBLE END AS ratio FROM j)
    SELECT symbol, session, reference, ok AND open < round((reference * (1 + ratio))::DECIMAL(18, 6), 2)::DOUBLE AS buy_ok, ok AND open > round((reference * (1 - ratio))::DECIMAL(18, 6), 2)::DOUBLE AS sell_ok FROM r""",
)
def p13(spark, sf):
    b = a.bars(spark, sf)
    j = b.join(a.adjustments(b), ["symbol", "session"], "left")
    w = Window.partitionBy("symbol").orderBy("session")
    ref = F.lag("close").over(w) * F.lag("adj_factor").over(w) / F.col("adj_factor")
    ratio = limit_ratio(F.when(F.substring("symbol", 6, 1).isin("3", "6"), "STAR").otherwise("MAIN"), F.lit(False))
    j = j.withColumn("reference", ref).withColumn("ratio", ratio)
    ok = (F.col("open") > 0) & (F.col("volume") > 0) & (F.col("adj_factor") > 0) & F.col("reference").isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    return j.withColumns({
        "buy_ok": ok & F.coalesce(F.col("open") < limit_price(F.col("reference"), F.col("ratio"), True), F.lit(True)),
        "sell_ok": ok & F.coalesce(F.col("open") > limit_price(F.col("reference"), F.col("ratio"), False), F.lit(True)),
    })


@query(
    "p5_p12_symbols_boards_limits", "symbol six board suffix", "ratio upper lower",
    """SELECT symbol, CASE WHEN regexp_matches(symbol, '^[0-9]{6}$') THEN symbol END AS six, board, CASE WHEN board = 'BSE' THEN 'BJ' WHEN symbol[1] IN ('6', '9') THEN 'SH' ELSE 'SZ' END AS suffix, ratio,
       round((p * (1 + ratio))::DECIMAL(18, 6), 2)::DOUBLE AS upper, round((p * (1 - ratio))::DECIMAL(18, 6), 2)::DOUBLE AS lower
    FROM (SELECT *, CASE WHEN st IS NULL OR st THEN .05::DOUBLE WHEN board = 'BSE' THEN .3::DOUBLE WHEN board IN ('STAR', 'CHINEXT') THEN .2::DOUBLE ELSE .1::DOUBLE END AS ratio
    FROM (SELECT *, CASE WHEN symbol LIKE '688%' THEN 'STAR' WHEN symbol LIKE '300%' OR symbol LIKE '301%' THEN 'CHINEXT' WHEN symbol LIKE '4%' OR symbol LIKE '8%' OR symbol LIKE '92%' THEN 'BSE' ELSE 'MAIN' END AS board
    FROM (SELECT lpad((p_partkey * 7919 % 1000000)::VARCHAR, 6, '0') AS symbol, p_retailprice AS p, CASE WHEN p_size > 45 THEN NULL ELSE p_size < 3 END AS st FROM part)))""",
)
def p5(spark, sf):
    code = F.lpad((F.col("p_partkey") * 7919 % 1000000).cast("string"), 6, "0")
    d = a.table(spark, sf, "part").select(code.alias("symbol"), F.col("p_retailprice").alias("p"), F.when(F.col("p_size") <= 45, F.col("p_size") < 3).alias("st"))
    d = d.withColumns({"six": six_digits(F.concat(F.lit("SH."), "symbol")), "board": board(F.col("symbol")), "suffix": exchange_suffix(F.col("symbol"))})
    d = d.withColumn("ratio", limit_ratio(F.col("board"), F.col("st")))
    return d.withColumns({"upper": limit_price(F.col("p"), F.col("ratio"), True), "lower": limit_price(F.col("p"), F.col("ratio"), False)})


@query(
    "a1_weekly_bars", "symbol week session", "open high low close volume amount",
    f"""WITH {DAILY} SELECT symbol, date_trunc('week', session + 2)::DATE AS week, max(session) AS session, arg_min(open, session) AS open, max(high) AS high, min(low) AS low,
        arg_max(close, session) AS close, sum(volume) AS volume, sum(amount) AS amount FROM daily GROUP BY 1, 2""",
)
def a1(spark, sf):
    return pit.resample(a.daily_bars(spark, sf), F.to_date(F.date_trunc("week", F.date_add("session", 2))), "week")
