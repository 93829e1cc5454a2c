"""The registry of queries and their SQL.

A query names its result columns: keys as they are, doubles rounded to six places on both sides, zero without a sign.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, keys: str, doubles: str = "", sql: str | None = None):
    """Register fn(spark, sf_dir) under name. sql may start with WITH; it is wrapped, so that it only has to provide the
    columns."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*keys.split(), *((F.round(F.col(d).cast("double"), 6) + F.lit(0.0)).alias(d) for d in doubles.split()))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = "SELECT " + ", ".join([*keys.split(), *(f"round({d}::DOUBLE, 6) + 0.0::DOUBLE AS {d}" for d in doubles.split())]) + f" FROM ({sql})"
        return fn

    return wrap


#: The adapters as SQL.
BARS = """
lines AS (SELECT lpad(l_suppkey::VARCHAR, 6, '0') AS symbol, l_shipdate, l_extendedprice / l_quantity AS price, l_quantity, l_extendedprice,
                 {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey, 'e': l_extendedprice} AS ord_key FROM lineitem),
bars AS (SELECT symbol, date_trunc('month', l_shipdate)::DATE AS session, arg_min(price, ord_key) AS open, max(price) AS high, min(price) AS low,
                arg_max(price, ord_key) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM lines GROUP BY 1, 2)"""
DAILY = BARS.replace("bars AS", "daily AS").replace("date_trunc('month', l_shipdate)::DATE", "l_shipdate::DATE")
ADJ = """
adj AS (SELECT symbol, session, CASE WHEN session >= DATE '1998-01-01' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS adj_factor FROM bars
        WHERE (symbol::INT + year(session) * 12 + month(session)) % 13 <> 0)"""
PX = """
px AS (SELECT b.*, a.adj_factor IS NULL AS degraded, b.close * coalesce(a.adj_factor, 1.0::DOUBLE) AS px FROM bars b LEFT JOIN adj a USING (symbol, session))"""
CAL = "cal AS (SELECT session, row_number() OVER (ORDER BY session) AS ord FROM (SELECT DISTINCT session FROM bars))"
DENSE = """
dense0 AS (SELECT s.symbol, c.session, c.ord, p.px AS px0, p.amount, p.volume FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN cal c LEFT JOIN px p ON p.symbol = s.symbol AND p.session = c.session),
dense AS (SELECT *, last_value(px0 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ord ROWS UNBOUNDED PRECEDING) AS px, coalesce(amount, volume, 0.0::DOUBLE) AS flow FROM dense0),
rets AS (SELECT *, px / nullif(lag(px) OVER (PARTITION BY symbol ORDER BY ord), 0) - 1 AS ret FROM dense),
pf AS (SELECT symbol, session, px / nullif(lag(px, 20) OVER w, 0) - 1 AS momentum_short, px / nullif(lag(px, 60) OVER w, 0) - 1 AS momentum_long,
              CASE WHEN count(ret) OVER (w ROWS 19 PRECEDING) = 20 THEN stddev_pop(ret) OVER (w ROWS 19 PRECEDING) * sqrt(252) END AS volatility,
              CASE WHEN lag(px, 10) OVER w IS NOT NULL THEN avg(flow) OVER (w ROWS 4 PRECEDING) / nullif(avg(flow) OVER (w ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING), 0) - 1 END AS turnover_change
       FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ord))"""
FACTORS = f"{BARS}, {ADJ}, {PX}, {CAL}, {DENSE}"
FIN = """
fin0 AS (SELECT lpad(o_custkey::VARCHAR, 6, '0') AS symbol, date_trunc('quarter', o_orderdate)::DATE AS q, sum(o_totalprice) AS revenue, avg(o_totalprice) AS mean_order, count(*)::DOUBLE AS orders FROM orders GROUP BY 1, 2),
fin AS (SELECT symbol, year(q) || 'Q' || quarter(q) AS period, metric, value, ((q + INTERVAL 3 MONTH)::DATE + 44) AS available
        FROM (UNPIVOT fin0 ON revenue, mean_order, orders INTO NAME metric VALUE value))"""
VAL = """
val AS (SELECT lpad(c_custkey::VARCHAR, 6, '0') AS symbol, c_nationkey AS nation, c_mktsegment, c_acctbal AS cap, p / nullif(c_acctbal, 0) AS pe, p / nullif(c_acctbal, 0) * n AS pb
        FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS p, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""
TICKS = "ticks AS (SELECT event_id, ts, lpad(user_id::VARCHAR, 6, '0') AS symbol, event_type, value, props FROM events)"


def avg_rank(value: str, by: str) -> str:
    """SQL: rank with ties sharing their mean rank."""
    part = f"PARTITION BY {by}" if by else ""
    ties = f"PARTITION BY {by + ', ' if by else ''}{value}"
    return f"CASE WHEN {value} IS NOT NULL THEN rank() OVER ({part} ORDER BY {value} NULLS LAST) + (count({value}) OVER ({ties}) - 1) / 2.0::DOUBLE END"


def scaled(value: str, by: str) -> str:
    """SQL: average rank scaled to 0..100; one value, or equal values, are 50."""
    part = f"PARTITION BY {by}" if by else ""
    return (
        f"CASE WHEN {value} IS NULL THEN NULL WHEN count({value}) OVER ({part}) <= 1 OR min({value}) OVER ({part}) = max({value}) OVER ({part}) THEN 50.0::DOUBLE "
        f"ELSE (({avg_rank(value, by)}) - 1) / (count({value}) OVER ({part}) - 1) * 100 END"
    )
