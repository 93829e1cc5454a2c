"""The screen's filters, and days of scores that are replaced behind a gate."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.functions.shared import shared_dir, staged
from tidemark.operators import screens as op
from tidemark.sources.merge import replace_partition

from .factors import SCORED, scored
from .registry import query
from .screening import STYLE, styled

SECURITIES = """se AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, 'N' || lpad(s_nationkey::VARCHAR, 2, '0') AS industry, s_acctbal AS cap, y.style FROM supplier LEFT JOIN sty y ON y.symbol = lpad(s_suppkey::VARCHAR, 6, '0') WHERE s_suppkey % 19 <> 0 AND s_suppkey % 17 <> 0)"""
FILTERS = {
    "all": "true", "industry": "industry IN ('N03', 'N05', 'N07')", "cap": "cap >= 3000", "style": "style = 'balanced'", "risk": "volatility > q[1] AND volatility <= q[2]", "watchlist": "symbol::INT % 3 = 0",
    "many": "cap >= 0 AND symbol::INT % 3 = 0 AND volatility <= q[1]",
}
SCREENS = f"""{SCORED}, {STYLE}, {SECURITIES}, th AS (SELECT session, quantile_cont(volatility, [1 / 3.0::DOUBLE, 2 / 3.0::DOUBLE]) AS q FROM pf WHERE volatility IS NOT NULL GROUP BY 1),
rw AS (SELECT s.symbol, s.session, s.score, s.momentum_short AS expected, s.volatility, e.industry, e.cap, e.style, q FROM sc s JOIN th USING (session) JOIN se e USING (symbol) WHERE s.score IS NOT NULL),
va AS ({" UNION ALL ".join(f"SELECT '{k}' AS screen, * FROM rw WHERE {v}" for k, v in FILTERS.items())}),
ra AS (SELECT *, row_number() OVER (PARTITION BY screen, session ORDER BY (expected IS NOT NULL)::INT DESC, coalesce(expected, score / 100) DESC, score DESC, symbol)::INTEGER AS rank FROM va)"""


def securities(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    s = a.table(spark, sf, "supplier").select(a.symbol("s_suppkey").alias("symbol"), F.format_string(" N%02d", "s_nationkey").alias("industry"), F.col("s_acctbal").alias("cap"), (k % 19 != 0).alias("listed"), (k % 17 == 0).alias("is_st"))
    return s.join(styled(spark, sf).select("symbol", "style"), "symbol", "left")


@query("p3_screen_filters", "screen session rank symbol industry style", "expected score", f"WITH {SCREENS} SELECT * FROM ra WHERE rank <= 5")
def p3(spark, sf):
    rows = staged(scored(spark, sf).select("symbol", "session", "score", F.col("momentum_short").alias("expected"), "volatility"), "scores")
    rows = rows.join(rows.where("volatility IS NOT NULL").select("session").distinct(), "session", "left_semi")
    s, watch = securities(spark, sf), rows.where(F.col("symbol").cast("int") % 3 == 0).select("symbol")
    asked = {
        "all": {}, "industry": {"industries": ["N03", " N05", "N07 ", ""]}, "cap": {"least_cap": 3000.0}, "style": {"style": "balanced"}, "risk": {"risk": "mid"}, "watchlist": {"watchlist": watch},
        "many": {"least_cap": 0.0, "watchlist": watch, "risk": "low"},
    }
    each = [op.best(op.filtered(rows, s, **k), 5).withColumn("screen", F.lit(name)).select("screen", "session", "rank", "symbol", "industry", "style", "expected", "score") for name, k in asked.items()]
    return reduce(DataFrame.union, each)


#: Scores of before are replaced by those of the sessions from 2000 on, but for sessions in which too few symbols have one.
GATE = 0.8


@query(
    "c2_s20_replaced_days", "session n", "score",
    f"""WITH {SCORED}, o AS (SELECT symbol, session, score + 1000 AS score FROM sc WHERE session < DATE '2001-06-01'), w AS (SELECT symbol, session, CASE WHEN month(session) <> 3 OR symbol::INT % 2 = 0 THEN score END AS score FROM sc WHERE session >= DATE '2000-01-01'),
    g AS (SELECT session FROM w GROUP BY 1 HAVING count(score) >= {GATE} * count(*)), t AS (SELECT * FROM o WHERE session NOT IN (SELECT session FROM g) UNION ALL SELECT * FROM w WHERE session IN (SELECT session FROM g))
    SELECT session, count(*) AS n, sum(score) AS score FROM t GROUP BY 1""",
)
def replaced(spark, sf):
    s = staged(scored(spark, sf).select("symbol", "session", "score"), "scores")
    path = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}"
    s.where("session < '2001-06-01'").withColumn("score", F.col("score") + 1000).write.partitionBy("session").parquet(path)
    half = F.when((F.month("session") != 3) | (F.col("symbol").cast("int") % 2 == 0), F.col("score"))
    replace_partition(op.gated(s.where("session >= '2000-01-01'").withColumn("score", half), "score", GATE), path, "session")
    return spark.read.parquet(path).groupBy("session").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
