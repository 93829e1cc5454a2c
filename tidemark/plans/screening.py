"""Screens, styles, risk, set comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.operators import factors as fo
from tidemark.operators import market as op

from .factors import SCORED, scored
from .registry import VAL, avg_rank, query

DEFENSIVE = ("HOUSEHOLD",)
STYLE = f"""{VAL}, v1 AS (SELECT *, CASE WHEN pe > 0 THEN pe END AS e1, CASE WHEN pb > 0 THEN pb END AS b1 FROM val),
v2 AS (SELECT *, ({avg_rank("e1", "nation")}) / count(e1) OVER (PARTITION BY nation) AS pe_pct, ({avg_rank("b1", "nation")}) / count(b1) OVER (PARTITION BY nation) AS pb_pct,
  (cap - avg(cap) OVER n) / nullif(stddev_pop(cap) OVER n, 0) AS profit_z FROM v1 WINDOW n AS (PARTITION BY nation)),
sty AS (SELECT *, abs(coalesce(pb, 0)) AS amount, CASE WHEN c_mktsegment = 'HOUSEHOLD' OR profit_z < -1.5 THEN 'defensive' WHEN pe_pct < .4 AND pb_pct < .4 THEN 'value' WHEN profit_z > .5 AND pe_pct > .5 THEN 'growth' ELSE 'balanced' END AS style FROM v2)"""


def styled(spark, sf) -> DataFrame:
    v = fo.valuation_ranks(fo.valuation_ranks(a.valuations(spark, sf), "pe", ["nation"], "pe_pct"), "pb", ["nation"], "pb_pct")
    n = Window.partitionBy("nation")
    z = F.try_divide(F.col("cap") - F.avg("cap").over(n), F.nullif(F.stddev_pop("cap").over(n), F.lit(0.0)))
    v = v.withColumn("profit_z", z).withColumn("vol_z", F.col("profit_z") + 1).withColumn("amount", F.abs(F.coalesce("pb", F.lit(0.0))))
    return op.style(v.withColumn("defensive", F.col("c_mktsegment").isin(*DEFENSIVE)))


@query("f6_style_tags", "symbol nation style", "pe_pct pb_pct profit_z", f"WITH {STYLE} SELECT * FROM sty")
def f6(spark, sf):
    return styled(spark, sf)


@query(
    "a7_x8_style_weights", "nation style n", "weight",
    f"""WITH {STYLE}, g AS (SELECT nation, style, count(*) AS n, sum(amount) AS amt FROM sty GROUP BY ALL),
    f AS (SELECT d.nation, d.style, coalesce(n, 0) AS n, coalesce(amt, 0) AS amt FROM (SELECT nation, unnest(['defensive', 'value', 'growth', 'balanced']) AS style FROM (SELECT DISTINCT nation FROM g)) AS d LEFT JOIN g USING (nation, style))
    SELECT nation, style, n, coalesce(amt / nullif(sum(amt) OVER (PARTITION BY nation), 0), 0) AS weight FROM f""",
)
def a7(spark, sf):
    return op.style_weights(styled(spark, sf), ["nation"])


SCREEN = f"""{SCORED}, rq AS (SELECT session, quantile_cont(volatility, [1 / 3.0::DOUBLE, 2 / 3.0::DOUBLE]) AS q FROM pf WHERE volatility IS NOT NULL GROUP BY 1),
sr AS (SELECT s.symbol, s.session, s.score, s.momentum_short AS expected, s.volatility, CASE WHEN s.volatility IS NULL THEN NULL WHEN s.volatility <= q[1] THEN 'low' WHEN s.volatility <= q[2] THEN 'medium' ELSE 'high' END AS risk FROM sc s LEFT JOIN rq USING (session) WHERE s.score IS NOT NULL),
sw AS (SELECT * FROM sr WHERE substr(symbol, 6, 1) <> '9' AND risk IN ('low', 'medium')),
sx AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY (expected IS NOT NULL)::INT DESC, coalesce(expected, score / 100) DESC, score DESC, symbol)::INTEGER AS rank FROM sw),
scr AS (SELECT * FROM sx WHERE rank <= 10)"""


def screen(spark, sf) -> DataFrame:
    s = op.risk_terciles(scored(spark, sf), "volatility", ["session"]).where("score is not null").withColumnRenamed("momentum_short", "expected")
    s = s.where((F.substring("symbol", 6, 1) != "9") & F.col("risk").isin("low", "medium"))
    return op.preselect(s, "expected", "score", ["session"], 10)


@query("c5_p3_k3_factor_screen", "session rank symbol risk", "expected score", f"WITH {SCREEN} SELECT * FROM scr")
def c5(spark, sf):
    return screen(spark, sf)


@query(
    "u3_screen_diff", "session symbol status", "",
    f"""WITH {SCREEN}, d AS (SELECT session, lead(session) OVER (ORDER BY session) AS nxt FROM (SELECT DISTINCT session FROM scr)), b AS (SELECT nxt AS session, symbol FROM scr JOIN d USING (session) WHERE nxt IS NOT NULL)
    SELECT coalesce(x.session, b.session) AS session, coalesce(x.symbol, b.symbol) AS symbol, CASE WHEN b.symbol IS NULL THEN 'new' WHEN x.symbol IS NULL THEN 'dropped' ELSE 'stayed' END AS status
    FROM (SELECT * FROM scr) x FULL JOIN b ON x.session = b.session AND x.symbol = b.symbol WHERE coalesce(x.session, b.session) <> (SELECT min(session) FROM scr)""",
)
def u3(spark, sf):
    return op.screen_diff(screen(spark, sf).select("session", "symbol"))


@query(
    "a30_style_exposure", "nation style n", "share",
    f"""WITH {STYLE}, c AS (SELECT nation, style, row_number() OVER (PARTITION BY nation ORDER BY amount DESC, symbol) AS rn FROM sty), k AS (SELECT * FROM c WHERE rn <= 30)
    SELECT n.nation, t.style, count(k.style) AS n, count(k.style) / any_value(n.total) AS share FROM (SELECT nation, count(*) AS total FROM k GROUP BY 1) n CROSS JOIN (SELECT unnest(['defensive', 'value', 'growth', 'balanced']) AS style) t
    LEFT JOIN k ON k.nation = n.nation AND k.style = t.style GROUP BY 1, 2""",
)
def a30(spark, sf):
    w = Window.partitionBy("nation").orderBy(F.desc("amount"), "symbol")
    return op.style_exposure(styled(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 30"), ["nation"])


@query("x8_style_row", "nation", "defensive value growth balanced", f"WITH {STYLE}, g AS (SELECT nation, sum(amount) AS t, " + ", ".join(f"coalesce(sum(amount) FILTER (style = '{s}'), 0) AS {s}" for s in ("defensive", "value", "growth", "balanced")) + " FROM sty GROUP BY 1) SELECT nation, " + ", ".join(f"coalesce({s} / nullif(t, 0), 0) AS {s}" for s in ("defensive", "value", "growth", "balanced")) + " FROM g")
def x8(spark, sf):
    return op.style_row(styled(spark, sf), ["nation"])


@query(
    "u2_calendar_union", "session", "",
    "WITH d AS (SELECT o_orderdate::DATE AS session, o_custkey % 50 AS k FROM orders) SELECT session FROM d WHERE k = 0 UNION SELECT session FROM d GROUP BY session HAVING count(DISTINCT k) >= 3",
)
def u2(spark, sf):
    d = a.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("session"), (F.col("o_custkey") % 50).alias("k"))
    quorum = d.groupBy("session").agg(F.countDistinct("k").alias("n")).where("n >= 3").select("session")
    return d.where("k = 0").select("session").union(quorum).distinct()


@query(
    "u4_u5_quoted_and_excluded", "symbol status", "",
    "WITH u AS (SELECT lpad(c_custkey::VARCHAR, 6, '0') AS symbol, c_custkey AS k FROM customer) SELECT symbol, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = k) THEN 'quoted' ELSE 'excluded' END AS status FROM u",
)
def u4(spark, sf):
    c = a.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    o = a.table(spark, sf, "orders").select("o_custkey")
    both = c.join(o, "o_custkey", "left_semi").withColumn("status", F.lit("quoted")).union(c.join(o, "o_custkey", "left_anti").withColumn("status", F.lit("excluded")))
    return both.select(a.symbol("o_custkey").alias("symbol"), "status")


@query("x75_industries", "industry", "", "SELECT DISTINCT trim(c_mktsegment) AS industry FROM customer WHERE trim(c_mktsegment) <> ''")
def x75(spark, sf):
    return a.table(spark, sf, "customer").select(F.trim("c_mktsegment").alias("industry")).where("industry <> ''").distinct()


@query(
    "k8_w24_latest_rows", "symbol rn event_id event_type", "value",
    "SELECT * FROM (SELECT lpad(user_id::VARCHAR, 6, '0') AS symbol, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS rn FROM events) WHERE rn <= 3",
)
def k8(spark, sf):
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("event_id"))
    return a.ticks(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 3")
