"""Report views over the adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.functions import clean
from tidemark.operators import factors as fo
from tidemark.operators import reports as op

from .factors import SCORED
from .registry import ADJ, BARS, PX, query

CHANGES = f"{BARS}, ch AS (SELECT symbol, session, close, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY session), 0) - 1 AS change FROM bars)"
PLATES = f"""{CHANGES}, pc AS (SELECT 'N' || lpad(s_nationkey::VARCHAR, 2, '0') AS plate, session, avg(change) AS change, count(change) AS members
  FROM ch JOIN supplier ON lpad(s_suppkey::VARCHAR, 6, '0') = symbol GROUP BY 1, 2 HAVING count(change) > 0),
pr AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY change DESC, plate)::INTEGER AS rank, count(*) OVER (PARTITION BY session) AS n, lead(change) OVER (PARTITION BY plate ORDER BY session) AS next FROM pc)"""


def changed(spark, sf) -> DataFrame:
    return op.changes(a.bars(spark, sf).select("symbol", "session", "close"))


def plate_changes(spark, sf) -> DataFrame:
    return op.plate_changes(changed(spark, sf), a.plates(spark, sf))


@query(
    "w25_moving_averages", "symbol session", "ma5 ma20 ma60",
    f"WITH {BARS} SELECT symbol, session, " + ", ".join(f"CASE WHEN count(close) OVER (w ROWS {k - 1} PRECEDING) = {k} THEN avg(close) OVER (w ROWS {k - 1} PRECEDING) END AS ma{k}" for k in (5, 20, 60)) + " FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session)",
)
def w25(spark, sf):
    return op.moving_averages(a.bars(spark, sf))


@query("a33_symbol_spans", "symbol first_session last_session n", "", f"WITH {BARS} SELECT symbol, min(session) AS first_session, max(session) AS last_session, count(*) AS n FROM bars GROUP BY 1")
def a33(spark, sf):
    return a.bars(spark, sf).groupBy("symbol").agg(F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.count("*").alias("n"))


@query(
    "k13_movers", "session side rank symbol", "change",
    f"""WITH {CHANGES}, k AS (SELECT * FROM ch WHERE change IS NOT NULL),
    r AS (SELECT session, 'gain' AS side, symbol, change, row_number() OVER (PARTITION BY session ORDER BY change DESC, symbol)::INTEGER AS rank FROM k
    UNION ALL SELECT session, 'loss', symbol, change, row_number() OVER (PARTITION BY session ORDER BY change, symbol)::INTEGER FROM k) SELECT * FROM r WHERE rank <= 5""",
)
def k13(spark, sf):
    return op.movers(changed(spark, sf))


@query("k2_top_sectors", "session rank plate members", "change", f"WITH {PLATES} SELECT * FROM pr WHERE rank <= greatest(1, (n + 4) // 5)")
def k2(spark, sf):
    return op.top_fifth(plate_changes(spark, sf))


@query(
    "a26_sector_call_excess", "session calls", "excess",
    f"WITH {PLATES} SELECT session, count(next) FILTER (rank <= 3) AS calls, avg(next) FILTER (rank <= 3) - median(next) AS excess FROM pr GROUP BY session HAVING count(next) FILTER (rank <= 3) > 0",
)
def a26(spark, sf):
    return op.call_excess(plate_changes(spark, sf))


@query(
    "a24_state_grid", "day event_type n", "",
    """WITH e AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT d.day, t.event_type, coalesce(e.n, 0) AS n FROM (SELECT DISTINCT day FROM e) d CROSS JOIN (SELECT DISTINCT event_type FROM e) t LEFT JOIN e ON e.day = d.day AND e.event_type = t.event_type""",
)
def a24(spark, sf):
    return op.count_grid(a.ticks(spark, sf).select(F.to_date("ts").alias("day"), "event_type"), "day", "event_type")


@query(
    "f20_f21_availability", "o_orderkey quarter available approximate", "",
    """SELECT o_orderkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter,
      (CASE WHEN o_orderkey % 5 = 0 THEN (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::DATE + 44 ELSE o_orderdate::DATE + 31 END)::TIMESTAMP - INTERVAL 8 HOUR AS available, o_orderkey % 5 = 0 AS approximate FROM orders""",
)
def f20(spark, sf):
    o = a.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    published = F.when(F.col("o_orderkey") % 5 != 0, F.date_add("d", 30))
    end = F.date_sub(F.add_months(F.trunc("d", "quarter"), 3), 1)
    at, approximate = op.availability(published, end)
    return o.select("o_orderkey", F.concat(F.year("d").cast("string"), F.lit("Q"), F.quarter("d").cast("string")).alias("quarter"), at.alias("available"), approximate.alias("approximate"))


@query(
    "p16_p17_market_windows", "event_id open closing", "",
    """WITH l AS (SELECT event_id, ts + INTERVAL 8 HOUR AS t FROM events), s AS (SELECT event_id, isodow(t) AS d, hour(t) * 3600 + minute(t) * 60 + second(t) AS s FROM l)
    SELECT event_id, d < 6 AND s BETWEEN 33900 AND 54300 AS open, s >= 54000 AND s < 54360 AS closing FROM s""",
)
def p16(spark, sf):
    s = clean.local_seconds(F.col("ts"))
    return a.ticks(spark, sf).select("event_id", clean.market_open(F.col("ts")).alias("open"), ((s >= 15 * 3600) & (s < 15 * 3600 + 360)).alias("closing"))


@query(
    "x38_first_industry", "symbol industry", "",
    """SELECT lpad(c_custkey::VARCHAR, 6, '0') AS symbol, coalesce(nullif(trim(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE ' ' END), ''), nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN n_name END), ''), 'R' || n_regionkey) AS industry
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def x38(spark, sf):
    n = a.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    c = a.table(spark, sf, "customer").join(n, "c_nationkey")
    one = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise(" ")
    two = F.when(F.col("c_custkey") % 2 == 0, F.col("n_name"))
    return c.select(a.symbol("c_custkey").alias("symbol"), op.first_filled(one, two, F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("industry"))


@query(
    "x61_window_split", "session part", "",
    f"WITH {BARS}, d AS (SELECT session, row_number() OVER (ORDER BY session) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT session FROM bars)) SELECT session, CASE WHEN i <= n * 7 // 10 THEN 'train' ELSE 'test' END AS part FROM d",
)
def x61(spark, sf):
    return op.split_calendar(a.bars(spark, sf))


FACTORS = ("momentum_short", "momentum_long", "volatility", "turnover_change")


@query(
    "x63_long_factors", "symbol session factor", "value",
    f"WITH {SCORED} SELECT * FROM (" + " UNION ALL ".join(f"SELECT symbol, session, '{f}' AS factor, {f} AS value FROM pf" for f in FACTORS) + ") WHERE value IS NOT NULL",
)
def x63(spark, sf):
    b = a.bars(spark, sf)
    return fo.price_factors(b, a.adjustments(b)).unpivot(["symbol", "session"], list(FACTORS), "factor", "value").where("value is not null")


@query("a29_factor_coverage", "session n " + " ".join(f"n_{f}" for f in FACTORS), "", f"WITH {SCORED} SELECT session, count(*) AS n, " + ", ".join(f"count({f}) AS n_{f}" for f in FACTORS) + " FROM pf GROUP BY session")
def a29(spark, sf):
    b = a.bars(spark, sf)
    return fo.price_factors(b, a.adjustments(b)).groupBy("session").agg(F.count("*").alias("n"), *(F.count(f).alias(f"n_{f}") for f in FACTORS))


SEEDS = [7919 * i % 1200 for i in range(20)]


@query("x47_seek", "target found", "", "WITH t AS (SELECT unnest([" + ", ".join(map(str, SEEDS)) + "])::BIGINT AS target) SELECT DISTINCT target, (SELECT min(event_id) FROM events WHERE event_id >= target)::BIGINT AS found FROM t")
def x47(spark, sf):
    return op.first_at_least(a.ticks(spark, sf), "event_id", sorted(set(SEEDS)))


@query(
    "w20_excess_returns", "symbol session", "change bench excess",
    f"WITH {CHANGES} SELECT c.symbol, c.session, c.change, b.change AS bench, c.change - b.change AS excess FROM ch c LEFT JOIN ch b ON b.session = c.session AND b.symbol = '000001'",
)
def w20(spark, sf):
    return op.excess_returns(changed(spark, sf), "000001")


@query(
    "u1_event_union", "symbol rn source id day", "",
    """WITH e AS (SELECT lpad(o_custkey::VARCHAR, 6, '0') AS symbol, 'order' AS source, o_orderkey::BIGINT AS id, o_orderdate::DATE AS day FROM orders
      UNION ALL SELECT lpad(user_id::VARCHAR, 6, '0'), 'event', event_id::BIGINT, ts::DATE FROM events)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC, source, id DESC)::INTEGER AS rn FROM e) WHERE rn <= 3""",
)
def u1(spark, sf):
    o = a.table(spark, sf, "orders").select(a.symbol("o_custkey").alias("symbol"), F.lit("order").alias("source"), F.col("o_orderkey").cast("long").alias("id"), F.to_date("o_orderdate").alias("day"))
    e = a.ticks(spark, sf).select("symbol", F.lit("event").alias("source"), F.col("event_id").cast("long").alias("id"), F.to_date("ts").alias("day"))
    return op.newest([o, e], 3)


@query(
    "x68_flow_coverage", "n_rows plates sessions", "coverage",
    f"WITH {PLATES} SELECT count(*) AS n_rows, count(DISTINCT plate) AS plates, count(DISTINCT session) AS sessions, count(*)::DOUBLE / (count(DISTINCT plate) * count(DISTINCT session)) AS coverage FROM pc",
)
def x68(spark, sf):
    c = plate_changes(spark, sf).agg(F.count("*").alias("n_rows"), F.countDistinct("plate").alias("plates"), F.countDistinct("session").alias("sessions"))
    return c.withColumn("coverage", F.try_divide(F.col("n_rows").cast("double"), (F.col("plates") * F.col("sessions")).cast("double")))


@query(
    "x76_run_list", "event_id event_type", "",
    """SELECT event_id, event_type FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1)
    UNION SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 20)""",
)
def x76(spark, sf):
    return op.run_list(a.ticks(spark, sf).select("event_id", "event_type", "ts"), "event_type", "ts", "event_id", 20)


@query(
    "c19_status_regressions", "event_id symbol", "",
    """SELECT event_id, symbol FROM (SELECT event_id, lpad(user_id::VARCHAR, 6, '0') AS symbol, ascii(event_type) AS r, lag(ascii(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE r < before""",
)
def c19(spark, sf):
    return op.status_regressions(a.ticks(spark, sf).select("event_id", "symbol", "ts", "event_type"), F.ascii("event_type"))


@query(
    "x39_anchored_factors", "symbol session", "factor",
    f"""WITH {BARS}, {ADJ}, {PX}, r AS (SELECT symbol, session, px / nullif(close, 0) AS raw FROM px)
    SELECT symbol, session, raw / first_value(raw) OVER (PARTITION BY symbol ORDER BY session) AS factor FROM r""",
)
def x39(spark, sf):
    b = a.bars(spark, sf).select("symbol", "session", "close")
    priced = b.join(a.adjustments(b), ["symbol", "session"], "left").withColumn("px", F.col("close") * F.coalesce("adj_factor", F.lit(1.0)))
    return op.anchored_factors(priced)
