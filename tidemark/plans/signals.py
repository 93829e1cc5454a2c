"""Quotes, provider audits and evidence classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.functions.clean import board
from tidemark.operators import factors as fo
from tidemark.operators import metrics as me
from tidemark.operators import signals as op

from .factors import NAMES, SCORED, price_factors
from .registry import avg_rank, query


@query(
    "p9_normalised_quotes", "symbol source", "last prev high amount change",
    """WITH r AS (SELECT lpad(user_id::VARCHAR, 6, '0') AS symbol, event_type AS source, event_id AS p, CASE WHEN event_id % 3 > 0 THEN value ELSE value + 1 END AS last, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS prev, CASE WHEN event_id % 4 = 0 THEN value * 2 END AS high, value - 1 AS amount FROM events WHERE event_id % 7 <> 0),
    k AS (SELECT * FROM r WHERE last > 0 AND prev > 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY p DESC) = 1)
    SELECT symbol, source, last, prev, coalesce(nullif(high, 0), last) AS high, greatest(amount, 0) AS amount, (last / prev - 1) * 100 AS change FROM k""",
)
def p9(spark, sf):
    e, k = a.table(spark, sf, "events"), F.col("event_id")
    raw = e.select(
        a.symbol("user_id").alias("symbol"), F.col("event_type").alias("source"), k.alias("priority"), F.when(k % 3 > 0, F.col("value").cast("string")).otherwise("nan").alias("last"),
        (F.col("value") + 1).alias("last_alt"), F.lit(None).cast("string").alias("prev"), F.when(k % 5 == 0, 0).otherwise(2).alias("prev_alt"), F.when(k % 4 == 0, F.col("value") * 2).alias("high"),
        (F.col("value") - 1).alias("amount"), (k % 7 == 0).alias("suspended"),
    )
    return op.normalise_quotes(raw)


@query(
    "p11_intraday_limits", "symbol", "pct",
    """SELECT symbol, CASE WHEN st THEN 5 WHEN symbol LIKE '688%' OR symbol LIKE '300%' OR symbol LIKE '301%' THEN 20 WHEN symbol LIKE '4%' OR symbol LIKE '8%' OR symbol LIKE '92%' THEN 30 ELSE 10 END AS pct
    FROM (SELECT lpad((p_partkey * 7919 % 1000000)::VARCHAR, 6, '0') AS symbol, p_size < 3 AS st FROM part)""",
)
def p11(spark, sf):
    code = F.lpad((F.col("p_partkey") * 7919 % 1000000).cast("string"), 6, "0")
    d = a.table(spark, sf, "part").select(code.alias("symbol"), (F.col("p_size") < 3).alias("st"))
    return d.withColumn("pct", op.intraday_limit(board(F.col("symbol")), F.col("st")))


@query(
    "x14_provider_audit", "event_id ok", "",
    "SELECT event_id, event_id % 4 IN (0, 2) AS ok FROM events",
)
def x14(spark, sf):
    k = F.col("event_id") % 4
    provider = F.when(k == 0, "cache-audited:exchange+vendor_a").when(k == 1, "cache-audited:exchange+mock").when(k == 2, "exchange").otherwise(F.lit(None))
    return a.table(spark, sf, "events").select("event_id", op.provider_audited(provider).alias("ok"))


@query(
    "f36_evidence_classes", "factor class", "",
    f"""WITH {SCORED}, fw AS (SELECT symbol, session, lead(px, 1) OVER (PARTITION BY symbol ORDER BY session) / px - 1 AS future FROM px),
    lg AS ({" UNION ALL ".join(f"SELECT session, symbol, '{f}' AS factor, z_{f} AS z FROM zs WHERE z_{f} IS NOT NULL" for f in NAMES)}),
    j AS (SELECT factor, session, z, future FROM lg JOIN fw USING (symbol, session) WHERE future IS NOT NULL),
    r AS (SELECT *, {avg_rank("z", "factor, session")} AS ra, {avg_rank("future", "factor, session")} AS rb FROM j),
    i AS (SELECT factor, session, CASE WHEN count(*) >= 2 AND stddev_pop(ra) > 1e-12 AND stddev_pop(rb) > 1e-12 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END AS ic FROM r GROUP BY ALL),
    s AS (SELECT factor, count(*) AS n, avg(ic) AS m, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*)) AS t FROM i WHERE ic IS NOT NULL GROUP BY 1)
    SELECT factor, CASE WHEN t IS NULL OR n < 2 THEN 'insufficient' WHEN abs(t) < 2 THEN 'ineffective' WHEN m < 0 THEN 'negative' ELSE 'positive' END AS class FROM s""",
)
def f36(spark, sf):
    b = a.bars(spark, sf)
    long = fo.standardise(price_factors(spark, sf), NAMES, ["session"]).unpivot(["session", "symbol"], [f"z_{f}" for f in NAMES], "factor", "z")
    j = long.join(me.forward_returns(fo.adjusted(b, a.adjustments(b)), (1,)), ["symbol", "session"])
    stats = me.ic_summary(me.rank_ic(j, "z", "future", ["factor", "session"]), ["factor"])
    return stats.select(F.substring("factor", 3, 100).alias("factor"), op.evidence_class(F.col("n"), F.col("mean"), F.col("t")).alias("class"))
