"""The walk-forward backtest and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.operators import backtest as op
from tidemark.operators import factors as fo
from tidemark.operators import metrics as me

from .factors import SCORED, p13, scored
from .registry import query


def prices(spark, sf) -> DataFrame:
    b = a.bars(spark, sf)
    px = b.join(a.adjustments(b), ["symbol", "session"]).select("symbol", "session", (F.col("open") * F.col("adj_factor")).alias("open_px"), (F.col("close") * F.col("adj_factor")).alias("close_px"))
    return px.join(p13(spark, sf).select("symbol", "session", "buy_ok", "sell_ok"), ["symbol", "session"])


def runs(spark, sf) -> DataFrame:
    s = scored(spark, sf).select("session", "symbol", "score")
    return op.decisions(s, {f"every_{n}": n for n in (1, 3)}, 0.1)


@query("c6_walk_forward", "run session holdings stale", "nav cash turnover")
def c6(spark, sf):
    return op.backtest(runs(spark, sf).select("run", "session", "symbol"), prices(spark, sf))


@query("c9_backtest_report", "run n", "total annual volatility sharpe drawdown calmar")
def c9(spark, sf):
    return me.nav_performance(c6(spark, sf), ["run"])


@query(
    "c6_decision_lists", "decided session symbol", "",
    f"""WITH {SCORED}, c AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS i, lead(session) OVER (ORDER BY session) AS nxt FROM (SELECT DISTINCT session FROM sc)),
    r AS (SELECT sc.session AS decided, nxt AS session, symbol, row_number() OVER (PARTITION BY sc.session ORDER BY score DESC, symbol) AS rank, count(*) OVER (PARTITION BY sc.session) AS n FROM sc JOIN c USING (session) WHERE score IS NOT NULL AND i % 3 = 0 AND nxt IS NOT NULL)
    SELECT decided, session, symbol FROM r WHERE rank <= ceil(n * .1)""",
)
def decided(spark, sf):
    return op.decisions(scored(spark, sf).select("session", "symbol", "score"), {"every_3": 3}, 0.1)


@query("x53_market_return", "session n", "ret", f"WITH {SCORED}, r AS (SELECT symbol, session, px / nullif(lag(px) OVER (PARTITION BY symbol ORDER BY session), 0) - 1 AS ret FROM px) SELECT session, count(ret) AS n, avg(ret) AS ret FROM r GROUP BY 1")
def x53(spark, sf):
    b = a.bars(spark, sf)
    return fo.daily_returns(b, a.adjustments(b)).groupBy("session").agg(F.count("ret").alias("n"), F.avg("ret").alias("ret"))


@query("x57_effective_window", "run session", "nav")
def x57(spark, sf):
    return me.effective_window(c6(spark, sf))
