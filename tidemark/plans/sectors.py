"""Sector panels and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.functions.shared import staged
from tidemark.operators import factors as fo
from tidemark.operators import sectors as op

from .registry import ADJ, BARS, CAL, PX, avg_rank, query

MEMBERS = "plates AS (SELECT 'N' || lpad(s_nationkey::VARCHAR, 2, '0') AS plate, lpad(s_suppkey::VARCHAR, 6, '0') AS symbol FROM supplier)"
RET = f"{BARS}, {ADJ}, {PX}, {MEMBERS}, ret AS (SELECT symbol, session, amount, px / nullif(lag(px) OVER (PARTITION BY symbol ORDER BY session), 0) - 1 AS ret FROM px)"
FLOWS = "flows AS (SELECT plate, session, sum(CASE WHEN close >= open THEN amount ELSE -amount END) AS flow FROM bars JOIN plates USING (symbol) WHERE plate <> 'N07' GROUP BY ALL)"
#: Gate of the query: its plates are small, so one member and half of all must report.
LEAST, COVERAGE, FLOW_SESSIONS, ORIGINS = 1, 0.5, 60, 40
PANEL = f"""{RET}, {CAL}, {FLOWS}, mem AS (SELECT plate, count(DISTINCT symbol) AS members FROM plates GROUP BY 1),
pa AS (SELECT plate, session, avg(ret) AS mean_ret, avg((ret > 0)::INT::DOUBLE) AS breadth, count(ret) AS active, sum(amount) AS amount FROM ret JOIN plates USING (symbol) GROUP BY ALL),
pg AS (SELECT m.plate, c.session, m.members, mean_ret, breadth, coalesce(active, 0) AS active, amount, coalesce(active, 0) / m.members AS coverage FROM mem m CROSS JOIN cal c LEFT JOIN pa ON pa.plate = m.plate AND pa.session = c.session WHERE c.ord > 1),
panel AS (SELECT * FROM pg QUALIFY min((active >= {LEAST} AND coverage >= {COVERAGE} AND mean_ret IS NOT NULL)::INT) OVER (PARTITION BY plate) = 1)"""
FEAT = f"""{PANEL},
pf0 AS (SELECT p.*, f.flow FROM panel p LEFT JOIN flows f USING (plate, session)),
f0 AS (SELECT *, 100 * exp(sum(ln(1 + mean_ret)) OVER (PARTITION BY plate ORDER BY session)) AS level FROM pf0),
f1 AS (SELECT *, level / lag(level, 5) OVER w - 1 AS mom_5, level / lag(level, 10) OVER w - 1 AS mom_10, level / lag(level, 20) OVER w - 1 AS mom_20,
  CASE WHEN count(mean_ret) OVER (w ROWS 13 PRECEDING) = 14 THEN avg(greatest(mean_ret, 0)) OVER (w ROWS 13 PRECEDING) END AS gain,
  CASE WHEN count(mean_ret) OVER (w ROWS 13 PRECEDING) = 14 THEN avg(greatest(-mean_ret, 0)) OVER (w ROWS 13 PRECEDING) END AS loss,
  CASE WHEN count(flow) OVER (w ROWS 4 PRECEDING) = 5 THEN sum(flow) OVER (w ROWS 4 PRECEDING) END AS flow_5, amount / nullif(lag(amount, 5) OVER w, 0) - 1 AS amount_change FROM f0 WINDOW w AS (PARTITION BY plate ORDER BY session)),
med AS (SELECT session, median(mom_20) AS m FROM f1 GROUP BY 1),
feat AS (SELECT f1.*, mom_20 - m AS rs, CASE WHEN gain IS NULL THEN NULL WHEN gain = 0 AND loss = 0 THEN 50 WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi,
  flow_5 - lag(flow_5) OVER (PARTITION BY plate ORDER BY session) AS flow_turn FROM f1 JOIN med USING (session))"""


def z(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN stddev_pop({c}) OVER d <= 1e-8 THEN 0 ELSE ({c} - avg({c}) OVER d) / stddev_pop({c}) OVER d END"


def scores_sql(h: int, part: str = "") -> str:
    """The scores of a horizon, as the CTE scores; part limits the plates."""
    return f"""s00 AS (SELECT * FROM feat {part}),
uf AS (SELECT count(*) = {FLOW_SESSIONS} AND bool_and(ok) AS use_flow FROM (SELECT session, count(flow) = count(*) AS ok FROM s00 GROUP BY 1 ORDER BY session DESC LIMIT {FLOW_SESSIONS})),
s0 AS (SELECT *, round(CASE WHEN use_flow THEN .35 * mom_{h} + .2 * {z("breadth")} + .2 * {z("rs")} + .25 * {z("flow_5")} ELSE (.35 * mom_{h} + .2 * {z("breadth")} + .2 * {z("rs")}) / .75 END, 9) AS raw, {z("flow_turn")} AS zf FROM s00, uf WINDOW d AS (PARTITION BY session)),
s1 AS (SELECT *, ({avg_rank("raw", "session")}) / count(raw) OVER (PARTITION BY session) * 100 AS score FROM s0),
s2 AS (SELECT *, score - lag(score, 5) OVER (PARTITION BY plate ORDER BY session) AS trend, CASE WHEN use_flow AND rsi IS NOT NULL THEN round(.4 * (100 - score) + .4 * zf + .2 * greatest(35 - rsi, 0), 9) END AS rv FROM s1),
scores AS (SELECT *, CASE WHEN trend IS NULL OR score IS NULL THEN NULL WHEN score > 80 AND rsi > 70 THEN 'boom' WHEN score > 60 AND trend > 0 THEN 'rising' WHEN trend < 0 AND score < 60 THEN 'decline' WHEN score < 30 AND trend >= 0 THEN 'bottoming'
   WHEN score BETWEEN 30 AND 60 AND trend > 0 AND flow_5 > 0 THEN 'recovery' END AS stage, ({avg_rank("rv", "session")}) / count(rv) OVER (PARTITION BY session) * 100 AS reversal FROM s2)"""


SCORES = f"{FEAT}, {scores_sql(20)}"


def returns(spark, sf) -> DataFrame:
    b = a.bars(spark, sf)
    return fo.daily_returns(b, a.adjustments(b)).join(b.select("symbol", "session", "amount"), ["symbol", "session"])


def panel(spark, sf) -> DataFrame:
    return op.panel(returns(spark, sf), a.plates(spark, sf), LEAST, COVERAGE)


def features(spark, sf) -> DataFrame:
    return op.features(op.with_flows(panel(spark, sf), a.flows(spark, sf)))


def scored(spark, sf, horizon: int = 20) -> DataFrame:
    return op.scores(features(spark, sf), horizon, FLOW_SESSIONS)


@query("a3_sector_panel", "plate session members active", "coverage mean_ret breadth amount", f"WITH {PANEL} SELECT * FROM panel")
def a3(spark, sf):
    return panel(spark, sf)


@query("w6_w11_sector_features", "plate session", "level mom_5 mom_10 mom_20 rs rsi flow_5 flow_turn amount_change", f"WITH {FEAT} SELECT * FROM feat")
def w6(spark, sf):
    return features(spark, sf)


@query("f9_without_flows", "plate session stage", "score trend reversal", f"WITH {FEAT}, {scores_sql(20, "")} SELECT * FROM scores".replace("f.flow FROM panel", "CASE WHEN p.plate <> 'N03' THEN f.flow END AS flow FROM panel"))
def f9_without(spark, sf):
    some = a.flows(spark, sf).where("plate <> 'N03'")
    return op.scores(op.features(op.with_flows(panel(spark, sf), some)), 20, FLOW_SESSIONS)


@query("f9_f11_sector_scores", "plate session stage", "score trend reversal", f"WITH {SCORES} SELECT * FROM scores")
def f9(spark, sf):
    return scored(spark, sf)


@query("a25_stage_counts", "session stage n", "", f"WITH {SCORES} SELECT session, coalesce(stage, 'none') AS stage, count(*) AS n FROM scores GROUP BY ALL")
def a25(spark, sf):
    return scored(spark, sf).groupBy("session", F.coalesce("stage", F.lit("none")).alias("stage")).agg(F.count("*").alias("n"))


@query("p15_overbought_reversal", "plate session view", "value", f"WITH {SCORES} SELECT plate, session, 'overbought' AS view, rsi AS value FROM scores WHERE rsi > 70 UNION ALL SELECT plate, session, 'reversal', reversal FROM scores WHERE reversal IS NOT NULL")
def p15(spark, sf):
    s = scored(spark, sf)
    return s.where("rsi > 70").select("plate", "session", F.lit("overbought").alias("view"), F.col("rsi").alias("value")).union(
        s.where("reversal is not null").select("plate", "session", F.lit("reversal"), "reversal")
    )


def c3_sql(h: int) -> str:
    return f"""SELECT * FROM (WITH {FEAT}, {scores_sql(h)}, v AS (SELECT *, lead(level, {h}) OVER (PARTITION BY plate ORDER BY session) / level - 1 AS future FROM scores),
    m AS (SELECT *, median(future) OVER (PARTITION BY session) AS mid FROM v), k AS (SELECT * FROM m WHERE score IS NOT NULL AND future IS NOT NULL),
    r AS (SELECT *, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY score DESC, plate) AS rank FROM k),
    t AS (SELECT * FROM r WHERE rank <= greatest(1, ceil(n * .2)) AND session IN (SELECT DISTINCT session FROM k ORDER BY session DESC LIMIT {ORIGINS}))
    SELECT {h} AS horizon, count(DISTINCT session) AS origins, count(*) AS samples, avg((future > mid)::INT::DOUBLE) AS win_rate, avg(future - mid) AS expected_excess FROM t)"""


@query("c3_rolling_validation", "horizon origins samples", "win_rate expected_excess", " UNION ALL ".join(c3_sql(h) for h in (5, 10, 20)))
def c3(spark, sf):
    f = staged(features(spark, sf), "sector-features")  # read once for each horizon
    each = [op.validation(op.scores(f, h, FLOW_SESSIONS), h, ORIGINS).withColumn("horizon", F.lit(h)) for h in (5, 10, 20)]
    return each[0].union(each[1]).union(each[2])


QUOTES = f"{RET}, q AS (SELECT p.plate, r.symbol, r.session, r.ret AS change, r.amount FROM ret r JOIN plates p USING (symbol))"


def quotes(spark, sf) -> DataFrame:
    return returns(spark, sf).join(a.plates(spark, sf), "symbol").withColumnRenamed("ret", "change")


@query(
    "a4_sector_strength", "plate session leader members", "mean_change breadth strength",
    f"""WITH {QUOTES}, t AS (SELECT *, row_number() OVER (PARTITION BY plate, session ORDER BY amount DESC, symbol) AS n FROM q WHERE change IS NOT NULL),
    g AS (SELECT plate, session, avg(change) AS mean_change, avg((change > 0)::INT::DOUBLE) AS breadth, arg_max(symbol, {{'a': change, 'b': symbol}}) AS leader, count(*) AS members FROM t WHERE n <= 3 GROUP BY ALL)
    SELECT *, least(greatest(5 + 1.2 * mean_change + 4 * (breadth - .5), 0), 10) AS strength FROM g""",
)
def a4(spark, sf):
    return op.strength(quotes(spark, sf).where("change is not null"), 3)


@query(
    "k7_plate_leaders", "plate session symbol", "change coverage",
    f"""WITH {QUOTES}, c AS (SELECT *, count(change) OVER (PARTITION BY plate, session) / count(*) OVER (PARTITION BY plate, session) AS coverage, row_number() OVER (PARTITION BY plate, session ORDER BY round(change, 12) DESC NULLS LAST, symbol) AS n FROM q)
    SELECT * FROM c WHERE n = 1 AND coverage >= .8 AND change IS NOT NULL""",
)
def k7(spark, sf):
    return op.leaders(quotes(spark, sf))


@query(
    "w26_leader_correlation", "plate symbol n", "corr",
    f"""WITH {QUOTES}, lead AS (SELECT plate, min(symbol) AS leader FROM plates GROUP BY 1),
    b AS (SELECT p.plate, p.symbol, x.ret, y.ret AS lr FROM plates p JOIN lead l USING (plate) JOIN ret x ON x.symbol = p.symbol JOIN ret y ON y.symbol = l.leader AND y.session = x.session WHERE p.symbol <> l.leader AND x.ret IS NOT NULL AND y.ret IS NOT NULL)
    SELECT plate, symbol, count(*) AS n, CASE WHEN count(*) >= 20 AND stddev_pop(ret) > 1e-12 AND stddev_pop(lr) > 1e-12 THEN covar_pop(ret, lr) / (stddev_pop(ret) * stddev_pop(lr)) END AS corr FROM b GROUP BY ALL""",
)
def w26(spark, sf):
    p = a.plates(spark, sf)
    return op.leader_correlation(returns(spark, sf), p, p.groupBy("plate").agg(F.min("symbol").alias("leader")))


@query(
    "w26_window_leaders", "plate rank symbol leader n", "total corr",
    f"""WITH {BARS}, {MEMBERS}, w21 AS (SELECT DISTINCT session FROM bars WHERE symbol = '000001' AND close > 0 ORDER BY session DESC LIMIT 21),
    o AS (SELECT symbol, session, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY session) - 1 AS ret FROM bars WHERE close > 0 AND session IN (SELECT session FROM w21)),
    p AS (SELECT symbol, arg_max(close, session) / arg_min(close, session) - 1 AS total FROM o GROUP BY 1 HAVING count(*) = 21 AND stddev_pop(ret) > 1e-12),
    l AS (SELECT plate, first_value(symbol) OVER (PARTITION BY plate ORDER BY total DESC, symbol) AS leader, symbol, total FROM plates JOIN p USING (symbol)),
    b AS (SELECT l.plate, l.symbol, l.leader, l.total, x.ret, y.ret AS lr FROM l JOIN o x ON x.symbol = l.symbol JOIN o y ON y.symbol = l.leader AND y.session = x.session WHERE l.symbol <> l.leader AND x.ret IS NOT NULL AND y.ret IS NOT NULL),
    c AS (SELECT plate, symbol, leader, total, count(*) AS n, covar_pop(ret, lr) / (stddev_pop(ret) * stddev_pop(lr)) AS corr FROM b GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY plate ORDER BY round(corr, 12) DESC, symbol)::INT AS rank FROM c""",
)
def w26_window(spark, sf):
    return op.window_leaders(a.bars(spark, sf), a.plates(spark, sf), "000001")


@query(
    "a5_exact_five_sessions", "plate", "flow",
    f"""WITH {PANEL}, f AS (SELECT plate, session, amount, CASE WHEN plate = 'N03' AND month(session) = 6 THEN 'b' ELSE 'a' END AS source FROM panel),
    l AS (SELECT DISTINCT session FROM f ORDER BY session DESC LIMIT 5)
    SELECT plate, sum(amount) AS flow FROM f WHERE session IN (SELECT session FROM l) GROUP BY plate HAVING count(amount) = 5 AND count(DISTINCT session) = 5 AND count(DISTINCT source) = 1""",
)
def a5(spark, sf):
    p = panel(spark, sf)
    source = F.when((F.col("plate") == "N03") & (F.month("session") == 6), "b").otherwise("a")
    return op.exact_days(p.select("plate", "session", F.col("amount").alias("flow"), source.alias("source")))


@query(
    "a6_top_member_flow", "plate session members", "flow",
    f"""WITH {RET}, m AS (SELECT plate, symbol, session, s_acctbal AS cap, CASE WHEN ret > -.5 THEN amount END AS flow FROM ret JOIN plates USING (symbol) JOIN supplier ON lpad(s_suppkey::VARCHAR, 6, '0') = symbol),
    t AS (SELECT *, row_number() OVER (PARTITION BY plate, session ORDER BY cap DESC, symbol) AS n FROM m)
    SELECT plate, session, count(*) AS members, CASE WHEN count(flow) = count(*) THEN sum(flow) END AS flow FROM t WHERE n <= 5 GROUP BY ALL""",
)
def a6(spark, sf):
    cap = a.table(spark, sf, "supplier").select(a.symbol("s_suppkey").alias("symbol"), F.col("s_acctbal").alias("cap"))
    m = returns(spark, sf).join(a.plates(spark, sf), "symbol").join(cap, "symbol").withColumn("flow", F.when(F.col("ret") > -0.5, F.col("amount")))
    return op.top_member_flow(m)


@query(
    "j13_symbol_sector_mean", "symbol", "strength",
    f"WITH {PANEL} SELECT symbol, avg(mean_ret) AS strength FROM plates JOIN panel USING (plate) GROUP BY symbol",
)
def j13(spark, sf):
    p = panel(spark, sf)
    return a.plates(spark, sf).join(p, "plate").groupBy("symbol").agg(F.avg("mean_ret").alias("strength"))


@query(
    "j23_u8_missing_grid", "plate session", "",
    f"""WITH {PANEL}, g AS (SELECT plate, session FROM (SELECT DISTINCT plate FROM plates) CROSS JOIN (SELECT DISTINCT session FROM panel))
    SELECT g.* FROM g LEFT JOIN (SELECT * FROM panel WHERE month(session) <> 7) p USING (plate, session) WHERE p.plate IS NULL""",
)
def j23(spark, sf):
    p = panel(spark, sf)
    grid = a.plates(spark, sf).select("plate").distinct().crossJoin(p.select("session").distinct())  # plates and sessions: two short lists
    return grid.join(p.where(F.month("session") != 7).select("plate", "session"), ["plate", "session"], "left_anti")
