"""Universes, memberships, the thirteen-factor cross-section and its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.functions.shared import staged
from tidemark.operators import factors as fo
from tidemark.operators import pit
from tidemark.operators import universe as op

from .factors import NAMES, price_factors
from .ingest import SRC, source_col
from .registry import BARS, FACTORS, FIN, VAL, avg_rank, query, scaled
from .sectors import FLOWS, MEMBERS

SEC = """sec AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, CASE WHEN s_suppkey % 17 = 0 THEN 'US' ELSE 'CN' END AS market, CASE WHEN s_suppkey % 13 = 0 THEN 'delisted' ELSE 'listed' END AS list_status, s_suppkey % 3 = 0 AS is_st,
  TIMESTAMP '1998-06-01 11:00:00' + INTERVAL 1 HOUR * (s_suppkey % 2) AS snapshot_at, CASE WHEN s_suppkey % 4 = 0 THEN 'unknown' ELSE (DATE '1994-12-01' + ((s_suppkey % 5) * 200)::INT)::VARCHAR END AS listed_date FROM supplier)"""
KNOWN = "session = DATE '1998-06-01' AND snapshot_at <= TIMESTAMP '1998-06-01 11:30:00'"


def securities(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("1998-06-01 11:00:00")) + 3600 * (k % 2))
    listed = F.when(k % 4 != 0, F.date_add(F.lit("1994-12-01").cast("date"), (k % 5 * 200).cast("int")).cast("string")).otherwise("unknown")
    return a.table(spark, sf, "supplier").select(
        a.symbol("s_suppkey").alias("symbol"), F.when(k % 17 == 0, "US").otherwise("CN").alias("market"), F.when(k % 13 == 0, "delisted").otherwise("listed").alias("list_status"),
        (k % 3 == 0).alias("is_st"), at.alias("snapshot_at"), listed.alias("listed_date"),
    )


def sourced(spark, sf) -> DataFrame:
    return a.bars(spark, sf).withColumn("source", source_col())


@query(
    "p1_j1_eligible_securities", "symbol session st_known", "",
    f"""WITH {BARS}, {SEC}, j AS (SELECT symbol, session, is_st, {KNOWN} AS st_known FROM bars JOIN sec USING (symbol) WHERE market = 'CN' AND list_status = 'listed' AND {SRC} <> 'mock' AND close > 0 AND volume > 0 AND amount > 0)
    SELECT symbol, session, st_known FROM j WHERE NOT (st_known AND is_st)""",
)
def p1(spark, sf):
    return op.eligible(securities(spark, sf), sourced(spark, sf))


@query(
    "p2_backtest_universe", "symbol session basis is_st", "",
    f"""WITH {BARS}, {SEC}, u AS (SELECT *, min(session) OVER (PARTITION BY symbol) AS first_bar FROM bars WHERE {SRC} <> 'mock'),
    j AS (SELECT u.symbol, session, CASE WHEN listed_date <> 'unknown' THEN 'master' ELSE 'first_bar' END AS basis, coalesce(try_cast(listed_date AS DATE), first_bar) AS since, CASE WHEN {KNOWN} THEN is_st END AS is_st
      FROM u JOIN sec USING (symbol) WHERE market = 'CN' AND list_status = 'listed' AND close > 0 AND volume > 0) SELECT symbol, session, basis, is_st FROM j WHERE since <= session - 60""",
)
def p2(spark, sf):
    return op.backtest_universe(securities(spark, sf), sourced(spark, sf))


ENDS = ("1996-03-01", "1999-09-01")


@query("j10_endpoint_returns", "symbol", "ret", f"WITH {FACTORS}, g AS (SELECT symbol, max(px) FILTER (session = DATE '{ENDS[0]}') AS a, max(px) FILTER (session = DATE '{ENDS[1]}') AS b FROM px WHERE session IN (DATE '{ENDS[0]}', DATE '{ENDS[1]}') GROUP BY 1) SELECT symbol, CASE WHEN a > 0 AND b > 0 THEN b / a - 1 END AS ret FROM g")
def j10(spark, sf):
    b = a.bars(spark, sf)
    return op.endpoint_return(fo.adjusted(b, a.adjustments(b)), *(F.lit(d).cast("date") for d in ENDS))


@query(
    "j4_benchmark_factor", "session", "px",
    f"WITH {FACTORS} SELECT session, close * coalesce(adj_factor, 1) AS px FROM bars LEFT JOIN adj USING (symbol, session) WHERE symbol = '000002'",
)
def j4(spark, sf):
    b = a.bars(spark, sf)
    return fo.adjusted(b.where("symbol = '000002'"), a.adjustments(b))


PIT = f"""{MEMBERS}, snap AS (SELECT plate, symbol, DATE '2000-01-03' AS as_of, DATE '2000-01-03' + (symbol::INT % 3)::INT AS available FROM plates WHERE symbol::INT % 2 = 0),
cur AS (SELECT plate, symbol, DATE '2000-01-01' + (symbol::INT % 6)::INT AS refreshed FROM plates UNION ALL SELECT 'X' || plate, symbol, DATE '2000-01-02' FROM plates WHERE symbol::INT % 5 = 0),
ex AS (SELECT DISTINCT plate, symbol FROM snap WHERE as_of = DATE '2000-01-03' AND available <= DATE '2000-01-04'), nowm AS (SELECT DISTINCT plate, symbol FROM cur WHERE refreshed <= DATE '2000-01-04'),
mem2 AS (SELECT *, 'snapshot' AS origin FROM ex UNION ALL SELECT *, 'current' FROM nowm WHERE plate NOT IN (SELECT plate FROM ex))"""


def members(spark, sf) -> DataFrame:
    p, k = a.plates(spark, sf), F.col("symbol").cast("int")
    day = F.lit("2000-01-03").cast("date")
    snap = p.where(k % 2 == 0).select("plate", "symbol", day.alias("as_of"), F.date_add(day, k % 3).alias("available"))
    twice = p.where(k % 5 == 0).select(F.concat(F.lit("X"), "plate").alias("plate"), "symbol", F.lit("2000-01-02").cast("date").alias("refreshed"))
    cur = p.select("plate", "symbol", F.date_add(F.lit("2000-01-01").cast("date"), k % 6).alias("refreshed")).union(twice)
    return op.memberships(snap, cur, F.lit("2000-01-04").cast("date"), day)


@query("j25_x44_pit_memberships", "plate symbol origin", "", f"WITH {PIT} SELECT * FROM mem2")
def j25(spark, sf):
    return members(spark, sf)


@query("x1_plate_lists", "symbol plates", "", f"WITH {PIT} SELECT symbol, string_agg(DISTINCT plate, ',' ORDER BY plate) AS plates FROM mem2 GROUP BY 1")
def x1(spark, sf):
    return op.plate_lists(members(spark, sf)).withColumn("plates", F.array_join("plates", ","))


@query(
    "x2_latest_strength", "day plate", "strength",
    """WITH s AS (SELECT event_id AS id, ts AS as_of, ts::DATE AS day, value, user_id FROM events QUALIFY row_number() OVER (PARTITION BY ts::DATE ORDER BY ts DESC, event_id DESC) = 1)
    SELECT day, 'P' || (user_id + i) AS plate, value * i AS strength FROM s, (SELECT unnest([1, 2]) AS i) WHERE value IS NOT NULL""",
)
def x2(spark, sf):
    t = a.table(spark, sf, "events")
    part = lambda i, v: F.struct(F.concat(F.lit("P"), (F.col("user_id") + i).cast("string")).alias("plate"), v.alias("strength"))
    payload = F.array(part(1, F.col("value").cast("string")), part(2, (F.col("value") * 2).cast("string")), part(3, F.lit("n/a")), part(4, F.lit("NaN")))
    return op.latest_strength(t.select(F.col("event_id").alias("id"), F.col("ts").alias("as_of"), F.to_date("ts").alias("day"), payload.alias("payload")))


METRICS = ["roe", "profit_yoy", "revenue_yoy", "ocf_to_profit", "debt_ratio"]
FIVE = f"""{FIN}, fq AS (SELECT symbol, period, available, left(period, 4)::INT * 4 + right(period, 1)::INT AS q, max(value) FILTER (metric = 'revenue') AS revenue, max(value) FILTER (metric = 'mean_order') AS mean_order, max(value) FILTER (metric = 'orders') AS orders FROM fin GROUP BY 1, 2, 3),
f5 AS (SELECT n.symbol, n.period, n.available, n.mean_order / 90011 AS roe, (n.orders - p.orders) / nullif(abs(p.orders), 0) AS profit_yoy, (n.revenue - p.revenue) / nullif(abs(p.revenue), 0) AS revenue_yoy, n.mean_order / nullif(n.revenue, 0) AS ocf_to_profit, 1 / (1 + n.orders) AS debt_ratio FROM fq n LEFT JOIN fq p ON p.symbol = n.symbol AND p.q = n.q - 4),
five AS (SELECT symbol, period, metric, value, available FROM (UNPIVOT f5 ON {", ".join(METRICS)} INTO NAME metric VALUE value))"""


def five_metrics(spark, sf) -> DataFrame:
    """(symbol, period, metric, value, available) of the five normalised metrics."""
    f = a.financials(spark, sf)
    wide = f.groupBy("symbol", "period", "available").agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("revenue", "mean_order", "orders")))
    yoy = pit.year_on_year(wide.withColumn("value", F.col("revenue"))).withColumnRenamed("yoy", "revenue_yoy")
    yoy = pit.year_on_year(yoy.withColumn("value", F.col("orders"))).withColumnRenamed("yoy", "profit_yoy")
    d = yoy.withColumns({"roe": F.col("mean_order") / 90011, "ocf_to_profit": F.try_divide(F.col("mean_order"), F.col("revenue")), "debt_ratio": 1 / (1 + F.col("orders"))})
    return d.unpivot(["symbol", "period", "available"], METRICS, "metric", "value").where("value is not null")


@query("f22_five_metrics", "symbol period metric", "value", f"WITH {FIVE} SELECT * FROM five WHERE value IS NOT NULL")
def f22(spark, sf):
    return five_metrics(spark, sf)


ALL = [*NAMES, *METRICS, "net_inflow", "sector_strength", "pe_percentile", "pb_percentile"]
#: Weights of the composite; flow and strength have no history and so no weight.
WEIGHTS = {"profit_yoy": 0.20, "pe_percentile": -0.18, "revenue_yoy": 0.16, "momentum_short": 0.12, "ocf_to_profit": 0.07, "turnover_change": 0.05, "net_inflow": 0.0, "sector_strength": 0.0}
C1 = f"""{FACTORS}, {FIVE}, {VAL}, {MEMBERS}, {FLOWS}, fl AS (SELECT plate, session, ord, flow FROM flows JOIN cal USING (session)),
fl5 AS (SELECT plate, session, CASE WHEN count(flow) OVER w = 5 THEN sum(flow) OVER w END AS flow_5 FROM fl WINDOW w AS (PARTITION BY plate ORDER BY ord RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)),
inf AS (SELECT symbol, session, avg(flow_5) AS net_inflow FROM plates JOIN fl5 USING (plate) WHERE flow_5 IS NOT NULL GROUP BY 1, 2),
stg AS (SELECT p.symbol, s.session, avg(s.strength) AS sector_strength FROM plates p JOIN (SELECT plate, session, avg(close / open) AS strength FROM bars JOIN plates USING (symbol) GROUP BY 1, 2) s USING (plate) GROUP BY 1, 2),
k0 AS (SELECT pf.*, {", ".join(f"{m}.value AS {m}" for m in METRICS)},
  CASE WHEN v.pe > 0 THEN v.pe END AS pe1, CASE WHEN v.pb > 0 THEN v.pb END AS pb1, net_inflow, sector_strength FROM pf LEFT JOIN val v USING (symbol) LEFT JOIN inf USING (symbol, session) LEFT JOIN stg USING (symbol, session)
  {" ".join(f"ASOF LEFT JOIN (SELECT * FROM five WHERE metric = '{m}' AND value IS NOT NULL) {m} ON {m}.symbol = pf.symbol AND pf.session >= {m}.available" for m in METRICS)}),
c13 AS (SELECT *, ({avg_rank("pe1", "session")}) / count(pe1) OVER (PARTITION BY session) AS pe_percentile, ({avg_rank("pb1", "session")}) / count(pb1) OVER (PARTITION BY session) AS pb_percentile FROM k0)"""


def cross_section(spark, sf, session=None) -> DataFrame:
    """The factors of every session, or of one: histories are read whole, the rest for that session alone."""
    p = a.plates(spark, sf)
    price = price_factors(spark, sf)
    if session is not None:
        price = price.where(F.col("session") == F.lit(session))
    strength = a.bars(spark, sf).join(p, "symbol").groupBy("plate", "session").agg(F.avg(F.col("close") / F.col("open")).alias("strength"))
    inflow = op.symbol_mean(p, op.five_session_flow(a.flows(spark, sf)), "flow_5", "net_inflow")
    return op.cross_section(price, five_metrics(spark, sf), METRICS, a.valuations(spark, sf), inflow, op.symbol_mean(p, strength, "strength", "sector_strength"))


@query("c1_factor_cross_section", "symbol session", " ".join(ALL), f"WITH {C1} SELECT * FROM c13")
def c1(spark, sf):
    return cross_section(spark, sf)


def z_sql(f: str) -> str:
    return f"CASE WHEN c_{f} IS NULL THEN NULL WHEN stddev_pop(c_{f}) OVER w <= 1e-8 THEN 0 ELSE (c_{f} - avg(c_{f}) OVER w) / stddev_pop(c_{f}) OVER w END AS z_{f}"


C2 = f"""{C1}, q13 AS (SELECT session, {", ".join(f"quantile_cont({f}, [0.025, 0.975]) AS q_{f}" for f in ALL)} FROM c13 GROUP BY 1),
l13 AS (SELECT c13.*, {", ".join(f"CASE WHEN {f} IS NOT NULL THEN least(greatest({f}, q_{f}[1]), q_{f}[2]) END AS c_{f}" for f in ALL)} FROM c13 JOIN q13 USING (session)),
z13 AS (SELECT *, {", ".join(z_sql(f) for f in ALL)} FROM l13 WINDOW w AS (PARTITION BY session)),
r13 AS (SELECT *, round(({" + ".join(f"coalesce(z_{f}, 0) * {v}" for f, v in WEIGHTS.items() if v)}) / nullif({" + ".join(f"CASE WHEN count(z_{f}) OVER w > 0 THEN {abs(v)}::DOUBLE ELSE 0 END" for f, v in WEIGHTS.items() if v)}, 0), 9) AS raw FROM z13 WINDOW w AS (PARTITION BY session)),
s13 AS (SELECT *, {scaled("raw", "session")} AS score, 5 + (coalesce(z_momentum_short, 0) + coalesce(z_momentum_long, 0)) AS t, 5 + 2 * coalesce(z_net_inflow, 0) AS c, 5 + (coalesce(z_roe, 0) + coalesce(z_profit_yoy, 0)) AS f, 5 - 2 * coalesce(z_pe_percentile, 0) AS v, 5 + 2 * coalesce(z_turnover_change, 0) AS s FROM r13),
d13 AS (SELECT *, {", ".join(f"least(greatest({c}, 0), 10) AS {n}" for c, n in zip("tcfvs", ("technical", "capital", "fundamental", "valuation", "sentiment")))} FROM s13)"""


@query(
    "c2_f7_daily_scores", "symbol session", "raw score technical capital fundamental valuation sentiment five_dim",
    f"WITH {C2} SELECT *, .25 * technical + .2 * capital + .25 * fundamental + .15 * valuation + .15 * sentiment AS five_dim FROM d13",
)
def c2(spark, sf):
    return daily_scores(cross_section(spark, sf))


def daily_scores(cross: DataFrame) -> DataFrame:
    z = fo.standardise(cross, ALL, ["session"])
    d = fo.five_dimensions(z.withColumns({"z_profit": F.col("z_profit_yoy"), "z_pe": F.col("z_pe_percentile")}))
    return fo.composite(d, WEIGHTS, ["session"])


@query("x78_latest_factors", "symbol session", "raw score", f"WITH {C2} SELECT symbol, session, raw, score FROM d13 WHERE session = (SELECT max(session) FROM d13 WHERE score IS NOT NULL)")
def x78(spark, sf):
    known = F.coalesce(*(F.col(f) for f, w in WEIGHTS.items() if w)).isNotNull()
    newest = a.bars(spark, sf).agg(F.max("session")).first()[0]
    cross = staged(cross_section(spark, sf, newest), "cross-section")
    if cross.where(known).isEmpty():  # the calendar's last session has no score: look through all
        cross = staged(cross_section(spark, sf), "cross-section")
    last = cross.where(known).agg(F.max("session").alias("session"))  # the newest session that any score can be made of
    return daily_scores(cross.join(F.broadcast(last), "session", "left_semi")).where("score is not null")
