"""Signal outcomes, attribution, deciles, trade arithmetic, guardrails, portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.operators import factors as fo
from tidemark.operators import market as op

from .factors import SCORED, WIDE_SQL, scored, wide
from .registry import query

OUT = f"""{WIDE_SQL}, cal AS (SELECT session, lead(session, 5) OVER (ORDER BY session) AS mature_on FROM (SELECT DISTINCT session FROM bars)),
ou AS (SELECT a.symbol, a.session, a.action, a.position_change, c.mature_on, x.close / nullif(e.close, 0) - 1 AS ret FROM alert a JOIN cal c USING (session) JOIN bars e ON e.symbol = a.symbol AND e.session = a.session JOIN bars x ON x.symbol = a.symbol AND x.session = c.mature_on),
outc AS (SELECT *, CASE WHEN position_change > 0 THEN ret > 0 WHEN position_change < 0 THEN ret < 0 END AS hit, position_change * ret + 0.0 AS contribution FROM ou),
vz AS (SELECT symbol, session, CASE WHEN symbol <> '000003' THEN vol_20 END AS z FROM wide WHERE symbol <> '000003'),
vq AS (SELECT session, quantile_cont(z, [1 / 3.0::DOUBLE, 2 / 3.0::DOUBLE]) AS q, count(z) AS n, count(DISTINCT z) AS d FROM vz GROUP BY 1),
oplate AS (SELECT o.*, CASE WHEN o.symbol::INT % 7 = 0 THEN 'unknown' ELSE 'N' || lpad(s_nationkey::VARCHAR, 2, '0') END AS plate,
  CASE WHEN vz.z IS NULL THEN 'unavailable' WHEN NOT (n >= 3 AND d >= 3) THEN 'insufficient' WHEN vz.z <= q[1] THEN 'low' WHEN vz.z <= q[2] THEN 'mid' ELSE 'high' END AS tercile
  FROM outc o JOIN supplier ON lpad(s_suppkey::VARCHAR, 6, '0') = o.symbol LEFT JOIN vz ON vz.symbol = o.symbol AND vz.session = o.session LEFT JOIN vq ON vq.session = o.session)"""


def outcomes(spark, sf) -> DataFrame:
    w = wide(spark, sf)
    p = a.plates(spark, sf)
    twice = p.where(F.col("symbol").cast("int") % 7 == 0).withColumn("plate", F.lit("X"))  # symbols of two plates
    o = op.single_plate(op.outcomes(fo.alerts(w), a.bars(spark, sf), 5), p.union(twice))
    return op.volatility_groups(o, w.where("symbol <> '000003'").select("symbol", "session", F.col("vol_20").alias("z")))


@query("c11_alert_outcomes", "symbol session action mature_on hit", "ret contribution", f"WITH {OUT} SELECT * FROM oplate")
def c11(spark, sf):
    return outcomes(spark, sf)


@query(
    "a22_attribution_sets", "action plate tercile n directional hits", "rate contribution",
    f"WITH {OUT} SELECT action, plate, tercile, count(*) AS n, count(hit) AS directional, count(*) FILTER (hit) AS hits, count(*) FILTER (hit) / nullif(count(hit), 0) AS rate, sum(contribution) AS contribution FROM oplate GROUP BY GROUPING SETS ((action), (plate), (tercile))",
)
def a22(spark, sf):
    return op.attribution(outcomes(spark, sf), ["action", "plate", "tercile"])


@query(
    "k6_hits_and_misses", "side symbol session rank", "contribution",
    f"""WITH {OUT}, r AS (SELECT 'hit' AS side, symbol, session, contribution, row_number() OVER (ORDER BY contribution DESC, session, symbol)::INTEGER AS rank FROM oplate WHERE hit
    UNION ALL SELECT 'miss', symbol, session, contribution, row_number() OVER (ORDER BY contribution, session, symbol)::INTEGER FROM oplate WHERE NOT hit) SELECT * FROM r WHERE rank <= 5""",
)
def k6(spark, sf):
    o = outcomes(spark, sf).select("symbol", "session", "hit", "contribution")
    best = o.where("hit").orderBy(F.desc("contribution"), "session", "symbol").limit(5).withColumn("side", F.lit("hit")).withColumn("o", -F.col("contribution"))
    worst = o.where("not hit").orderBy("contribution", "session", "symbol").limit(5).withColumn("side", F.lit("miss")).withColumn("o", F.col("contribution"))
    return best.union(worst).withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy("o", "session", "symbol")))


@query(
    "j17_pending_outcomes", "symbol session action", "",
    f"WITH {OUT} SELECT a.symbol, a.session, a.action FROM alert a LEFT JOIN oplate o ON o.symbol = a.symbol AND o.session = a.session WHERE o.symbol IS NULL",
)
def j17(spark, sf):
    return fo.alerts(wide(spark, sf)).join(outcomes(spark, sf).select("symbol", "session"), ["symbol", "session"], "left_anti")


@query(
    "j9_a8_decile_outcomes", "decile samples positives", "rate",
    f"""WITH {SCORED}, c2 AS (SELECT session, lead(session, 20) OVER (ORDER BY session) AS m FROM (SELECT DISTINCT session FROM bars)),
    j AS (SELECT least(floor(s.score / 10) + 1, 10)::INTEGER AS decile, x.close / nullif(e.close, 0) - 1 AS r FROM sc s JOIN c2 USING (session) JOIN bars e ON e.symbol = s.symbol AND e.session = s.session JOIN bars x ON x.symbol = s.symbol AND x.session = c2.m WHERE s.score IS NOT NULL),
    g AS (SELECT decile, count(*) AS samples, count(*) FILTER (r > 0) AS positives FROM j WHERE r IS NOT NULL GROUP BY 1)
    SELECT i::INTEGER AS decile, coalesce(samples, 0) AS samples, coalesce(positives, 0) AS positives, positives / nullif(samples, 0) AS rate FROM range(1, 11) t(i) LEFT JOIN g ON g.decile = i""",
)
def j9(spark, sf):
    s = scored(spark, sf).select("symbol", "session", F.lit("score").alias("action"), F.lit(1.0).alias("position_change"), "score")
    return op.decile_outcomes(op.outcomes(s, a.bars(spark, sf), 20), "score", "ret")


@query(
    "a9_monotone_rates", "monotone", "",
    f"""WITH {SCORED}, c2 AS (SELECT session, lead(session, 20) OVER (ORDER BY session) AS m FROM (SELECT DISTINCT session FROM bars)),
    j AS (SELECT least(floor(s.score / 10) + 1, 10)::INTEGER AS decile, x.close / nullif(e.close, 0) - 1 AS r FROM sc s JOIN c2 USING (session) JOIN bars e ON e.symbol = s.symbol AND e.session = s.session JOIN bars x ON x.symbol = s.symbol AND x.session = c2.m WHERE s.score IS NOT NULL),
    g AS (SELECT decile, count(*) FILTER (r > 0) / count(*) AS rate FROM j WHERE r IS NOT NULL GROUP BY 1), l AS (SELECT rate >= lag(rate) OVER (ORDER BY decile) AS ok FROM g) SELECT coalesce(bool_and(ok), true) AS monotone FROM l""",
)
def a9(spark, sf):
    g = j9(spark, sf).where("rate is not null")
    ok = F.col("rate") >= F.lag("rate").over(Window.orderBy("decile"))  # ten rows
    return g.select(ok.alias("ok")).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("monotone"))


@query(
    "f14_f18_trade_arithmetic", "o_orderkey lots cost_e7", "limit_price",
    """SELECT o_orderkey, (floor(o_totalprice / px / 100) * 100)::BIGINT AS lots,
       round((CASE WHEN a <= 0 THEN 0 ELSE greatest(a * .00025, 5) + CASE WHEN sell THEN a * .001 ELSE 0 END + a * .00002 + a * .0005 END)::DOUBLE * 10000000)::BIGINT AS cost_e7,
       CASE WHEN NOT sell THEN ceil((px * 1.01::DOUBLE)::DECIMAL(18, 6) * 100) / 100 ELSE floor((px * .99::DOUBLE)::DECIMAL(18, 6) * 100) / 100 END AS limit_price
    FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_totalprice END AS a, o_orderstatus = 'F' AS sell, o_totalprice / (100 + o_orderkey % 900) AS px FROM orders)""",
)
def f14(spark, sf):
    o = a.table(spark, sf, "orders").withColumn("px", F.col("o_totalprice") / (100 + F.col("o_orderkey") % 900)).withColumn("sell", F.col("o_orderstatus") == "F")
    amount = F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(F.col("o_totalprice"))
    return o.withColumns({"lots": op.order_size(F.col("o_totalprice"), F.col("px")), "cost_e7": F.round(op.trade_cost(amount, F.col("sell")) * 10_000_000).cast("long"), "limit_price": op.order_limit(F.col("px"), ~F.col("sell"))})


MODES = ("RESEARCH", "PAPER_AUTO", "LIMITED_LIVE_AUTO", "CONFIRM_TO_TRADE")


@query(
    "p19_guardrails", "symbol session reasons approved confirm", "",
    f"""WITH {WIDE_SQL}, g0 AS (SELECT symbol, session, symbol::INT AS k, month(session) AS m, conf20 + .2 AS confidence, p20, p5, position_change FROM alert),
    g1 AS (SELECT *, [{", ".join(f"'{x}'" for x in MODES)}][(k + m) % 4 + 1] AS mode, CASE WHEN k % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, p20 / 8 AS ord, p5 / 12 AS pos, p20 / 3 AS sector, CASE WHEN m = 2 THEN -.02 ELSE -p5 / 40 END AS pnl, m * 15 - 20 AS age FROM g0),
    g2 AS (SELECT *, pos + CASE WHEN side = 'BUY' THEN ord ELSE -ord END AS after FROM g1),
    g AS (SELECT *, list_sort(list_filter([CASE WHEN mode = 'RESEARCH' THEN 'mode' END, CASE WHEN mode = 'LIMITED_LIVE_AUTO' THEN 'live_disabled' END, CASE WHEN confidence < .68 THEN 'confidence' END,
      CASE WHEN age < -5 THEN 'future_data' END, CASE WHEN age > 120 THEN 'stale_data' END, CASE WHEN after > .10 THEN 'single_position' END, CASE WHEN side = 'SELL' AND after < -1e-9 THEN 'oversell' END,
      CASE WHEN sector + ord > .30 THEN 'sector_exposure' END, CASE WHEN pnl <= -.02 THEN 'daily_loss' END, CASE WHEN k % 11 > 0 AND m % 5 = 0 THEN 'open_order' END, CASE WHEN side = 'BUY' AND ord * 1000000 > 60000 THEN 'cash' END], lambda x: x IS NOT NULL)) AS l FROM g2)
    SELECT symbol, session, array_to_string(l, ',') AS reasons, len(l) = 0 AS approved, mode IN ('CONFIRM_TO_TRADE', 'LIMITED_LIVE_AUTO') AS confirm FROM g""",
)
def p19(spark, sf):
    d = fo.alerts(wide(spark, sf))
    k, m = F.col("symbol").cast("int"), F.month("session")
    return op.guardrails(d.withColumns({
        "mode": F.element_at(F.array(*(F.lit(x) for x in MODES)), (k + m) % 4 + 1), "side": F.when(k % 3 == 0, "SELL").otherwise("BUY"), "confidence": F.col("conf20") + 0.2, "equity": F.lit(1_000_000.0),
        "notional": F.col("p20") / 8 * 1_000_000, "cash": F.lit(60_000.0), "position": F.col("p5") / 12, "sector": F.col("p20") / 3, "day_pnl": F.when(m == 2, -0.02).otherwise(-F.col("p5") / 40),
        "open_orders": F.when((k % 11 > 0) & (m % 5 == 0), 1).otherwise(0), "age": m * 15 - 20,
    }))


@query(
    "a23_portfolio_industries", "book industry holdings", "value weight",
    """WITH m AS (SELECT o_orderpriority AS book, lpad(c_custkey::VARCHAR, 6, '0') AS symbol, coalesce(nullif(trim(c_mktsegment), ''), 'unknown') AS industry, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT book, industry, count(*) AS holdings, sum(v) AS value, sum(v) / sum(sum(v)) OVER (PARTITION BY book) AS weight FROM m GROUP BY 1, 2""",
)
def a23(spark, sf):
    industry = F.coalesce(F.nullif(F.trim("c_mktsegment"), F.lit("")), F.lit("unknown"))
    c = a.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), industry.alias("industry"))
    merged = a.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("book"), "o_custkey").agg(F.sum("o_totalprice").alias("v"))
    g = merged.join(c, "o_custkey").groupBy("book", "industry").agg(F.count("*").alias("holdings"), F.sum("v").alias("value"))
    return g.withColumn("weight", F.col("value") / F.sum("value").over(Window.partitionBy("book")))
