"""Data health reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.operators import health as op

from .registry import ADJ, BARS, DAILY, FIN, query


@query(
    "a28_bar_audit", "n symbols sessions first last invalid crossed weekend", "",
    f"""WITH {DAILY} SELECT count(*) AS n, count(DISTINCT symbol) AS symbols, count(DISTINCT session) AS sessions, min(session) AS first, max(session) AS last,
    count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS invalid, count(*) FILTER (low > least(open, close) OR high < greatest(open, close)) AS crossed, count(*) FILTER (isodow(session) >= 6) AS weekend FROM daily""",
)
def a28(spark, sf):
    return op.bar_audit(a.daily_bars(spark, sf))


@query("x73_duplicate_keys", "l_suppkey l_shipdate n", "", "SELECT l_suppkey, l_shipdate::DATE AS l_shipdate, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def x73(spark, sf):
    return op.duplicate_keys(a.table(spark, sf, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("l_shipdate")), ["l_suppkey", "l_shipdate"])


@query("j18_orphan_factors", "symbol session side", "", f"WITH {BARS}, {ADJ} SELECT symbol, session, 'left' AS side FROM bars ANTI JOIN adj USING (symbol, session) UNION ALL SELECT symbol, session, 'right' FROM adj ANTI JOIN bars USING (symbol, session)")
def j18(spark, sf):
    b = a.bars(spark, sf)
    return op.orphans(b, a.adjustments(b), ["symbol", "session"])


@query("a28_sparse_sessions", "session symbols", "", f"WITH {DAILY}, p AS (SELECT session, count(DISTINCT symbol) AS symbols FROM daily GROUP BY 1) SELECT * FROM p WHERE symbols < (SELECT median(symbols) FROM p) * .8")
def sparse(spark, sf):
    return op.sparse_sessions(a.daily_bars(spark, sf), 0.8)


@query(
    "f34_depth_buckets", "bucket symbols", "",
    """WITH d AS (SELECT o_custkey, count(DISTINCT o_orderdate::DATE) AS n FROM orders GROUP BY 1), g AS (SELECT least(n // 10, 4) AS b, count(*) AS symbols FROM d GROUP BY 1)
    SELECT CASE WHEN i = 4 THEN '40+' ELSE (i * 10) || '-' || (i * 10 + 9) END AS bucket, coalesce(symbols, 0) AS symbols FROM range(5) t(i) LEFT JOIN g ON b = i""",
)
def f34(spark, sf):
    return op.depth_buckets(a.table(spark, sf, "orders").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("session")))


@query(
    "a34_table_fingerprint", "n digest", "",
    "SELECT count(*) AS n, (sum(('0x' || substr(md5(coalesce(o_orderkey::VARCHAR, '~') || '|' || coalesce(o_custkey::VARCHAR, '~') || '|' || coalesce(o_orderstatus, '~')), 1, 12))::BIGINT) % 1152921504606846976)::BIGINT AS digest FROM orders",
)
def a34(spark, sf):
    return op.fingerprint(a.table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("x43_period_depth", "symbol quarters years latest deep", "", f"WITH {FIN} SELECT symbol, count(DISTINCT period) AS quarters, count(DISTINCT left(period, 4)) AS years, max(period) AS latest, count(DISTINCT period) >= 8 AS deep FROM fin WHERE value IS NOT NULL GROUP BY 1")
def x43(spark, sf):
    return op.period_depth(a.financials(spark, sf), 8)


@query("x45_probe_dates", "session i", "", f"WITH {BARS}, s AS (SELECT session, row_number() OVER (ORDER BY session) - 20 AS i FROM (SELECT DISTINCT session FROM bars)), t AS (SELECT * FROM s WHERE i > 0) SELECT session, i::INTEGER AS i FROM t WHERE i = 1 OR i = (SELECT max(i) FROM t) // 2 + 1 OR i = (SELECT max(i) FROM t)")
def x45(spark, sf):
    return op.probe_dates(a.bars(spark, sf).select("session").distinct(), 20)


@query("a10_coverage", "session symbols ok", "coverage", f"WITH {DAILY}, r AS (SELECT count(DISTINCT symbol) AS n FROM daily) SELECT session, count(DISTINCT symbol) AS symbols, count(DISTINCT symbol) / any_value(r.n) AS coverage, count(DISTINCT symbol) / any_value(r.n) >= .2 AS ok FROM daily, r GROUP BY session")
def a10(spark, sf):
    d = a.daily_bars(spark, sf)
    total = d.agg(F.countDistinct("symbol").alias("t"))
    g = d.groupBy("session").agg(F.countDistinct("symbol").alias("symbols")).crossJoin(F.broadcast(total))  # one row
    return g.withColumn("coverage", F.col("symbols") / F.col("t")).withColumn("ok", F.col("coverage") >= 0.2)


@query(
    "j19_semi_observed", "c_custkey", "",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-01')",
)
def j19(spark, sf):
    o = a.table(spark, sf, "orders").where("o_orderdate >= '1998-01-01' and o_orderdate < '1998-02-01'")
    return a.table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query(
    "j24_strict_calendars", "equal missing extra", "",
    "WITH x AS (SELECT DISTINCT o_orderdate::DATE AS s FROM orders WHERE o_orderstatus = 'F'), y AS (SELECT DISTINCT o_orderdate::DATE AS s FROM orders WHERE o_orderstatus = 'O') SELECT count(*) FILTER (x.s IS NULL) + count(*) FILTER (y.s IS NULL) = 0 AS equal, count(*) FILTER (y.s IS NULL) AS missing, count(*) FILTER (x.s IS NULL) AS extra FROM x FULL JOIN y USING (s)",
)
def j24(spark, sf):
    o = a.table(spark, sf, "orders").select("o_orderstatus", F.to_date("o_orderdate").alias("s"))
    x, y = (o.where(F.col("o_orderstatus") == k).select("s").distinct().withColumn(k, F.lit(1)) for k in "FO")
    j = x.join(y, "s", "full").agg(F.count_if(F.col("O").isNull()).alias("missing"), F.count_if(F.col("F").isNull()).alias("extra"))
    return j.withColumn("equal", F.col("missing") + F.col("extra") == 0)
