"""Signal metrics: information coefficients, layers, decay, correlations, performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.operators import factors as fo
from tidemark.operators import metrics as op

from .factors import FORE_SQL, NAMES, SCORED, price_factors, scored
from .registry import avg_rank, query

H = (1, 5, 10)
FWD = f"""{SCORED}, fw0 AS (SELECT symbol, session, {", ".join(f"lead(px, {h}) OVER w / nullif(px, 0) - 1 AS h{h}" for h in H)} FROM px WINDOW w AS (PARTITION BY symbol ORDER BY session)),
fwd AS ({" UNION ALL ".join(f"SELECT symbol, session, {h} AS horizon, h{h} AS future FROM fw0" for h in H)}),
sf AS (SELECT s.symbol, s.session, s.score, f.horizon, f.future FROM sc s JOIN fwd f USING (symbol, session) WHERE s.score IS NOT NULL AND f.future IS NOT NULL),
rk AS (SELECT *, {avg_rank("score", "horizon, session")} AS ra, {avg_rank("future", "horizon, session")} AS rb FROM sf),
ic AS (SELECT horizon, session, count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_pop(ra) > 1e-12 AND stddev_pop(rb) > 1e-12 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END AS ic FROM rk GROUP BY ALL)"""


def with_future(spark, sf, horizons=H) -> DataFrame:
    b = a.bars(spark, sf)
    return scored(spark, sf).select("symbol", "session", "score").join(op.forward_returns(fo.adjusted(b, a.adjustments(b)), horizons), ["symbol", "session"])


def daily_ic(spark, sf) -> DataFrame:
    return op.rank_ic(with_future(spark, sf), "score", "future", ["horizon", "session"])


@query("a12_rank_ic", "horizon session n", "ic", f"WITH {FWD} SELECT * FROM ic")
def a12(spark, sf):
    return daily_ic(spark, sf)


@query(
    "a11_a20_ic_decay", "horizon n", "mean std ir t positive",
    f"""WITH {FWD}, g AS (SELECT horizon, count(*) AS n, avg(ic) AS mean, stddev_samp(ic) AS std, avg((ic > 0)::INT::DOUBLE) AS positive FROM ic WHERE ic IS NOT NULL GROUP BY 1)
    SELECT *, mean / nullif(std, 0) AS ir, mean / nullif(std, 0) * sqrt(n) AS t FROM g""",
)
def a20(spark, sf):
    return op.ic_summary(daily_ic(spark, sf), ["horizon"])


LAYERS = f"""{FWD}, li AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score, symbol) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM sf WHERE horizon = 5),
lay AS (SELECT session, (CASE WHEN n = 1 THEN 9 ELSE least(9, i * 10 // (n - 1)) END)::INTEGER AS layer, count(*) AS n, avg(future) AS ret FROM li GROUP BY 1, 2)"""


@query("a13_layered_returns", "session layer n", "ret", f"WITH {LAYERS} SELECT * FROM lay")
def a13(spark, sf):
    return op.layers(with_future(spark, sf, (5,)), "score", "future", ["session"])


@query("a14_a19_long_short", "layer sessions", "mean_ret mean_spread", f"WITH {LAYERS}, ls AS (SELECT session, arg_max(ret, layer) - arg_min(ret, layer) AS spread FROM lay GROUP BY 1) SELECT layer, count(*) AS sessions, avg(ret) AS mean_ret, avg(spread) AS mean_spread FROM lay JOIN ls USING (session) GROUP BY 1")
def a14(spark, sf):
    lay = op.layers(with_future(spark, sf, (5,)), "score", "future", ["session"])
    return lay.join(op.long_short(lay, ["session"]), "session").groupBy("layer").agg(F.count("*").alias("sessions"), F.avg("ret").alias("mean_ret"), F.avg("spread").alias("mean_spread"))


CORR = f"""{SCORED}, lg AS ({" UNION ALL ".join(f"SELECT session, symbol, '{f}' AS factor, z_{f} AS z FROM zs WHERE z_{f} IS NOT NULL" for f in NAMES)}),
cd AS (SELECT l.factor AS lf, r.factor AS rf, session, CASE WHEN count(*) >= 3 AND stddev_pop(l.z) > 1e-12 AND stddev_pop(r.z) > 1e-12 THEN covar_pop(l.z, r.z) / (stddev_pop(l.z) * stddev_pop(r.z)) END AS c
       FROM lg l JOIN lg r USING (session, symbol) WHERE l.factor <= r.factor AND session IN (SELECT session FROM cal WHERE (ord - 1) % 20 = 0) GROUP BY ALL)"""


@query("a18_factor_correlation", "left_factor right_factor days", "corr", f"WITH {CORR} SELECT lf AS left_factor, rf AS right_factor, count(*) AS days, avg(c) AS corr FROM cd WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 3")
def a18(spark, sf):
    return op.factor_correlation(fo.standardise(price_factors(spark, sf), NAMES, ["session"]), NAMES).withColumnsRenamed({"left": "left_factor", "right": "right_factor"})


@query(
    "f35_c8_ir_weights", "factor", "ir weight",
    f"""WITH {SCORED}, fw AS (SELECT symbol, session, lead(px, 1) OVER (PARTITION BY symbol ORDER BY session) / px - 1 AS future FROM px),
    lg AS ({" UNION ALL ".join(f"SELECT session, symbol, '{f}' AS factor, z_{f} AS z FROM zs WHERE z_{f} IS NOT NULL" for f in NAMES)}),
    j AS (SELECT factor, session, z, future FROM lg JOIN fw USING (symbol, session) WHERE future IS NOT NULL),
    r AS (SELECT *, {avg_rank("z", "factor, session")} AS ra, {avg_rank("future", "factor, session")} AS rb FROM j),
    i AS (SELECT factor, session, CASE WHEN count(*) >= 2 AND stddev_pop(ra) > 1e-12 AND stddev_pop(rb) > 1e-12 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END AS ic FROM r GROUP BY ALL),
    s AS (SELECT factor, avg(ic) / nullif(stddev_samp(ic), 0) AS ir FROM i WHERE ic IS NOT NULL GROUP BY 1)
    SELECT factor, ir, (CASE WHEN factor <> 'volatility' THEN ir ELSE 0 END) / sum(abs(CASE WHEN factor <> 'volatility' THEN ir ELSE 0 END)) OVER () AS weight FROM s""",
)
def f35(spark, sf):
    b = a.bars(spark, sf)
    z = fo.standardise(price_factors(spark, sf), NAMES, ["session"])
    long = z.select("session", "symbol", F.expr(f"stack({len(NAMES)}, {', '.join(f"'{f}', z_{f}" for f in NAMES)}) as (factor, z)"))
    j = long.join(op.forward_returns(fo.adjusted(b, a.adjustments(b)), (1,)), ["symbol", "session"])
    stats = op.ic_summary(op.rank_ic(j, "z", "future", ["factor", "session"]), ["factor"])
    return op.ir_weights(stats, F.col("factor") != "volatility")


NAV = """daynav AS (SELECT o_orderpriority AS book, o_orderdate::DATE AS session, 100 + avg(o_totalprice) / 10000 + (sum(o_totalprice) / 1000) % 7 AS nav FROM orders GROUP BY 1, 2)"""


def nav(spark, sf) -> DataFrame:
    o = a.table(spark, sf, "orders")
    value = 100 + F.avg("o_totalprice") / 10000 + (F.sum("o_totalprice") / 1000) % 7
    return o.groupBy(F.col("o_orderpriority").alias("book"), F.to_date("o_orderdate").alias("session")).agg(value.alias("nav"))


@query(
    "a15_w19_nav_performance", "book n", "total annual volatility sharpe drawdown calmar",
    f"""WITH {NAV}, d AS (SELECT *, nav / lag(nav) OVER w - 1 AS r, nav / max(nav) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM daynav WINDOW w AS (PARTITION BY book ORDER BY session)),
    g AS (SELECT book, count(*) AS n, arg_max(nav, session) / arg_min(nav, session) - 1 AS total, nullif(stddev_samp(r), 0) AS sd, avg(r) AS m, min(dd) AS drawdown FROM d GROUP BY 1 HAVING min(nav) > 0),
    h AS (SELECT *, pow(1 + total, 252.0::DOUBLE / (n - 1)) - 1 AS annual, sd * sqrt(252) AS volatility FROM g) SELECT *, m * 252 / nullif(volatility, 0) AS sharpe, annual / nullif(abs(drawdown), 0) AS calmar FROM h""",
)
def a15(spark, sf):
    return op.nav_performance(nav(spark, sf), ["book"])


@query(
    "x28_rebased_attribution", "book session", "nav_index bench_index excess",
    f"""WITH {NAV}, b AS (SELECT session, nav AS bench FROM daynav WHERE book = '1-URGENT' AND day(session) % 5 <> 0), j AS (SELECT d.book, d.session, d.nav, b.bench FROM daynav d LEFT JOIN b USING (session) WHERE d.book <> '1-URGENT'),
    r AS (SELECT *, nav / first_value(nav) OVER w AS nav_index, bench / first_value(bench IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS bench_index FROM j WINDOW w AS (PARTITION BY book ORDER BY session))
    SELECT *, nav_index / bench_index - 1 AS excess FROM r""",
)
def x28(spark, sf):
    n = nav(spark, sf)
    bench = n.where((F.col("book") == "1-URGENT") & (F.dayofmonth("session") % 5 != 0)).select("session", F.col("nav").alias("bench"))
    j = n.where("book <> '1-URGENT'").join(bench, "session", "left")
    w = Window.partitionBy("book").orderBy("session").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    j = j.withColumn("nav_index", F.col("nav") / F.first("nav").over(w)).withColumn("bench_index", F.col("bench") / F.first("bench", ignorenulls=True).over(w))
    return j.withColumn("excess", F.col("nav_index") / F.col("bench_index") - 1)


@query(
    "a16_turnover", "book n", "total mean median max annual",
    """WITH t AS (SELECT o_orderpriority AS book, o_orderdate::DATE AS session, CASE WHEN day(o_orderdate) % 5 = 0 THEN avg(o_totalprice) / 500000 END AS turnover FROM orders GROUP BY 1, 2, day(o_orderdate))
    SELECT book, count(turnover) AS n, sum(turnover) AS total, avg(turnover) AS mean, median(turnover) AS median, max(turnover) AS max, sum(turnover) * 252 / count(*) AS annual FROM t GROUP BY 1""",
)
def a16(spark, sf):
    o = a.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("book"), F.to_date("o_orderdate").alias("session")).agg((F.avg("o_totalprice") / 500000).alias("x"))
    return op.turnover_stats(o.withColumn("turnover", F.when(F.dayofmonth("session") % 5 == 0, F.col("x"))), "turnover", ["book"])


@query(
    "a17_a27_calibration", "bin n", "mean_p rate brier",
    f"""WITH {FORE_SQL}, nx AS (SELECT symbol, session, lead(close) OVER (PARTITION BY symbol ORDER BY session) / close - 1 AS r FROM bars),
    d AS (SELECT p_up, (r >= 0)::INT AS hit FROM fore JOIN nx USING (symbol, session) WHERE horizon = 1 AND r IS NOT NULL),
    g AS (SELECT least(floor(p_up * 10), 9)::INTEGER AS bin, count(*) AS n, avg(p_up) AS mean_p, avg(hit::DOUBLE) AS rate FROM d GROUP BY 1)
    SELECT i::INTEGER AS bin, coalesce(n, 0) AS n, mean_p, rate, (SELECT avg(pow(p_up - hit, 2)) FROM d) AS brier FROM range(10) t(i) LEFT JOIN g ON g.bin = i""",
)
def a17(spark, sf):
    b = a.bars(spark, sf)
    w = Window.partitionBy("symbol").orderBy("session")
    nx = b.select("symbol", "session", (F.lead("close").over(w) / F.col("close") - 1).alias("r"))
    d = fo.forecasts(fo.technical(b), (1,)).join(nx, ["symbol", "session"]).withColumn("hit", (F.col("r") >= 0).cast("int"))
    return op.calibration(d, "p_up", "hit")
