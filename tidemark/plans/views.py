"""The sector forecast view: which cross-section is shown, why, and with what beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.operators import forecasts as op

from .registry import query
from .sectors import FLOWS, QUOTES, quotes, returns

BENCHMARK = "000001"
#: The three newest sessions have every other symbol from a source that is not audited; of their forecasts the newest lacks
#: plates in one horizon, the next has two models, the third lacks a horizon.
VIEW = f"""{QUOTES}, {FLOWS},
days AS (SELECT session, row_number() OVER (ORDER BY session DESC) AS r FROM (SELECT DISTINCT session FROM ret)),
src AS (SELECT b.*, CASE WHEN d.r <= 3 AND symbol::INT % 2 = 0 THEN 'mock' WHEN (symbol::INT + month(session)) % 29 = 0 THEN 'mock' ELSE 'exchange' END AS source FROM bars b JOIN days d USING (session)),
fc0 AS (SELECT plate, q.session, avg(change) AS m, r FROM q JOIN days USING (session) WHERE change IS NOT NULL GROUP BY ALL),
fc AS (SELECT plate, session, h AS horizon, m * h - m * m AS score, CASE WHEN r = 2 AND plate < 'N05' THEN 'm2' ELSE 'm1' END AS model FROM fc0, (VALUES (5), (10), (20)) v(h)
       WHERE NOT (r = 1 AND h = 20 AND right(plate, 1) IN ('1', '4', '7')) AND NOT (r = 3 AND h = 10)),
cov AS (SELECT *, max(symbols) OVER (ORDER BY session) AS reference FROM (
    SELECT session, count(DISTINCT symbol) FILTER (symbol <> '{BENCHMARK}') AS symbols, bool_or(symbol = '{BENCHMARK}') AS benchmark FROM src WHERE source = 'exchange' AND close > 0 GROUP BY 1)),
hz AS (SELECT session, count(*) AS horizons, count(*) FILTER (horizon IN (5, 10, 20)) AS wanted, min(p) AS least FROM (SELECT session, horizon, count(DISTINCT plate) AS p FROM fc GROUP BY ALL) GROUP BY 1),
al AS (SELECT session, count(DISTINCT plate) AS plates, count(DISTINCT model) AS models FROM fc GROUP BY 1),
au AS (SELECT session, horizons, plates, models, coalesce(symbols / nullif(reference, 0)::DOUBLE, 0) AS ratio,
       CASE WHEN horizons <> 3 OR wanted <> 3 THEN 'horizons' WHEN least <> plates THEN 'plates' WHEN models <> 1 THEN 'models' WHEN NOT coalesce(benchmark, false) THEN 'benchmark'
            WHEN coalesce(symbols / nullif(reference, 0)::DOUBLE, 0) < {op.FLOOR}::DOUBLE THEN 'coverage' END AS reason
       FROM hz JOIN al USING (session) LEFT JOIN cov USING (session))"""


def days(spark, sf) -> DataFrame:
    d = returns(spark, sf).select("session").distinct()
    return d.withColumn("r", F.row_number().over(Window.orderBy(F.desc("session"))))  # the list of sessions


def sourced(spark, sf) -> DataFrame:
    s = F.col("symbol").cast("int")
    mock = ((F.col("r") <= 3) & (s % 2 == 0)) | ((s + F.month("session")) % 29 == 0)
    return a.bars(spark, sf).join(F.broadcast(days(spark, sf)), "session").withColumn("source", F.when(mock, "mock").otherwise("exchange"))


def forecasts(spark, sf) -> DataFrame:
    m = quotes(spark, sf).where("change is not null").groupBy("plate", "session").agg(F.avg("change").alias("m")).join(F.broadcast(days(spark, sf)), "session")
    each = m.withColumn("horizon", F.explode(F.array(*map(F.lit, op.HORIZONS))))
    each = each.where(~((F.col("r") == 1) & (F.col("horizon") == 20) & F.substring("plate", -1, 1).isin("1", "4", "7")) & ~((F.col("r") == 3) & (F.col("horizon") == 10)))
    model = F.when((F.col("r") == 2) & (F.col("plate") < "N05"), "m2").otherwise("m1")
    return each.select("plate", "session", "horizon", (F.col("m") * F.col("horizon") - F.col("m") * F.col("m")).alias("score"), model.alias("model"))


@query("k10_complete_cross_sections", "session horizons plates models reason", "ratio", f"WITH {VIEW} SELECT * FROM au")
def k10(spark, sf):
    return op.audit(forecasts(spark, sf), sourced(spark, sf), BENCHMARK)


STATE = f"""{VIEW}, best AS (SELECT max(session) AS session FROM au WHERE reason IS NULL), last AS (SELECT session AS newest, symbols / reference::DOUBLE AS last_ratio FROM cov WHERE benchmark ORDER BY session DESC LIMIT 1),
ign AS (SELECT coalesce(string_agg(session::VARCHAR || ':' || reason, ',' ORDER BY session DESC), '') AS ignored FROM au WHERE session > (SELECT session FROM best)),
st AS (SELECT session, newest, last_ratio AS ratio, ignored, (newest > session AND last_ratio < {op.FLOOR}::DOUBLE) OR ignored <> '' AS stale,
       CASE WHEN newest > session AND last_ratio < {op.FLOOR}::DOUBLE THEN 'partial market' WHEN ignored <> '' THEN 'ignored cross-sections' END AS warning FROM best, last, ign)"""


@query("x32_forecast_state", "session newest ignored stale warning", "ratio", f"WITH {STATE} SELECT * FROM st")
def x32(spark, sf):
    b = sourced(spark, sf)
    return op.state(op.audit(forecasts(spark, sf), b, BENCHMARK), b, BENCHMARK)


@query(
    "c16_sector_forecast_view", "plate horizon session rank leader stale ignored", "score recent_flow leader_change",
    f"""WITH {STATE}, fl AS (SELECT * FROM flows WHERE session <= (SELECT session FROM best)), l5 AS (SELECT DISTINCT session FROM fl ORDER BY session DESC LIMIT 5),
    f5 AS (SELECT plate, sum(flow) AS recent_flow FROM fl WHERE session IN (SELECT session FROM l5) GROUP BY plate HAVING count(flow) = 5 AND count(DISTINCT session) = 5),
    ld AS (SELECT plate, symbol AS leader, change AS leader_change FROM (SELECT *, count(change) OVER (PARTITION BY plate) / count(*) OVER (PARTITION BY plate) AS c, row_number() OVER (PARTITION BY plate ORDER BY round(change, 12) DESC NULLS LAST, symbol) AS n
           FROM q WHERE session = (SELECT session FROM best)) WHERE n = 1 AND c >= .8 AND change IS NOT NULL)
    SELECT plate, horizon, session, row_number() OVER (PARTITION BY horizon ORDER BY score DESC NULLS LAST, plate) AS rank, leader, stale, ignored, score, recent_flow, leader_change
    FROM fc JOIN st USING (session) LEFT JOIN f5 USING (plate) LEFT JOIN ld USING (plate)""",
)
def c16(spark, sf):
    b, f = sourced(spark, sf), forecasts(spark, sf)
    flows = a.flows(spark, sf).withColumn("source", F.lit("a"))
    return op.view(f, op.state(op.audit(f, b, BENCHMARK), b, BENCHMARK), flows, quotes(spark, sf))
