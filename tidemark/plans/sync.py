"""Tables kept in step: incremental factors, snapshots, repaired partitions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.functions.shared import shared_dir
from tidemark.operators import sync as op

from .registry import ADJ, BARS, FIN, query

# ---------------------------------------------------------------- factors

#: Symbols by their number modulo 5 know nothing, lack the head, the tail, both, or nothing; one in seven has another source
#: than what is offered; one in eleven is offered nothing.
KNOWN = f"""{BARS}, {ADJ},
kn AS (SELECT symbol, session, adj_factor, CASE WHEN symbol::INT % 7 = 0 THEN 'vendor_b' ELSE 'vendor_a' END AS source FROM adj
       WHERE symbol::INT % 5 <> 0 AND (symbol::INT % 5 NOT IN (1, 3) OR session >= DATE '1996-06-01') AND (symbol::INT % 5 NOT IN (2, 3) OR session < DATE '2000-03-01')),
off AS (SELECT symbol, session, adj_factor + .01::DOUBLE AS adj_factor, 'vendor_a' AS source FROM adj WHERE symbol::INT % 11 <> 0),
sp AS (SELECT symbol, min(session) AS first, max(session) AS last FROM bars GROUP BY 1),
hv AS (SELECT symbol, min(session) AS lo, max(session) AS hi, arg_max(source, session) AS known_source FROM kn GROUP BY 1),
rq AS (SELECT symbol, 'head' AS part, first AS lo, lo - 1 AS hi, known_source FROM sp JOIN hv USING (symbol) WHERE lo > first
       UNION ALL SELECT symbol, 'tail', hi + 1, last, known_source FROM sp JOIN hv USING (symbol) WHERE hi < last
       UNION ALL SELECT symbol, 'all', first, last, NULL FROM sp WHERE symbol NOT IN (SELECT symbol FROM hv)),
gt AS (SELECT o.*, r.known_source FROM off o JOIN rq r ON r.symbol = o.symbol AND o.session BETWEEN r.lo AND r.hi),
rp AS (SELECT sp.symbol, coalesce(r.requested, 0) AS requested, coalesce(g.received, 0) AS received,
       CASE WHEN r.symbol IS NULL THEN 'skipped' WHEN g.symbol IS NULL THEN 'no_data' WHEN coalesce(r.k, 'vendor_a') <> 'vendor_a' THEN 'source_changed' ELSE 'synced' END AS status
       FROM sp LEFT JOIN (SELECT symbol, count(*) AS requested, max(known_source) AS k FROM rq GROUP BY 1) r USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS received FROM gt GROUP BY 1) g USING (symbol)),
fr AS (SELECT symbol, session, adj_factor, source FROM gt WHERE symbol IN (SELECT symbol FROM rp WHERE status = 'synced'))"""


def known(spark, sf) -> DataFrame:
    s = F.col("symbol").cast("int")
    k = a.adjustments(a.bars(spark, sf)).where((s % 5 != 0) & (~(s % 5).isin(1, 3) | (F.col("session") >= "1996-06-01")) & (~(s % 5).isin(2, 3) | (F.col("session") < "2000-03-01")))
    return k.withColumn("source", F.when(s % 7 == 0, "vendor_b").otherwise("vendor_a"))


def offered(spark, sf) -> DataFrame:
    o = a.adjustments(a.bars(spark, sf)).where(F.col("symbol").cast("int") % 11 != 0)
    return o.select("symbol", "session", (F.col("adj_factor") + 0.01).alias("adj_factor"), F.lit("vendor_a").alias("source"))


@query("x41_request_windows", "symbol part lo hi known_source", "", f"WITH {KNOWN} SELECT * FROM rq WHERE lo <= hi")
def x41_windows(spark, sf):
    return op.request_windows(a.bars(spark, sf), known(spark, sf))


@query("x41_synced_factors", "symbol session source", "adj_factor", f"WITH {KNOWN} SELECT * FROM fr UNION ALL SELECT kn.* FROM kn WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.symbol = kn.symbol AND fr.session = kn.session)")
def x41_synced(spark, sf):
    return op.sync_factors(a.bars(spark, sf), known(spark, sf), offered(spark, sf))[0]


@query("x41_sync_report", "symbol status requested received covered", "", f"WITH {KNOWN} SELECT *, symbol IN (SELECT symbol FROM kn UNION SELECT symbol FROM fr) AS covered FROM rp")
def x41_report(spark, sf):
    return op.sync_factors(a.bars(spark, sf), known(spark, sf), offered(spark, sf))[1]


# ---------------------------------------------------------------- snapshots


def digest_sql(table: str) -> str:
    row = "concat_ws('|', coalesce(available::VARCHAR, '~'), coalesce(period, '~'), coalesce(symbol, '~'), coalesce(value::VARCHAR, '~'))"
    return f"SELECT metric, count(*) AS n, (sum(('0x' || substr(md5({row}), 1, 12))::BIGINT) % {2**60})::BIGINT AS digest FROM {table} GROUP BY 1"


@query(
    "s24_snapshot_transfer", "metric n digest after_n after_digest added", "",
    f"""WITH {FIN}, f AS (SELECT symbol, period, metric, value::DECIMAL(18, 2) AS value, available FROM fin WHERE metric <> 'mean_order'), t AS (SELECT * FROM f WHERE symbol::INT % 3 <> 0 OR period < '1997Q1'),
    s AS (SELECT * FROM f WHERE period >= '1996Q1'), u AS (SELECT * FROM t UNION SELECT * FROM s)
    SELECT x.metric, x.n, x.digest, y.n AS after_n, y.digest AS after_digest, y.n - z.n AS added FROM ({digest_sql("s")}) x JOIN ({digest_sql("u")}) y USING (metric) JOIN ({digest_sql("t")}) z USING (metric)""",
)
def s24(spark, sf):
    f = a.financials(spark, sf).where("metric <> 'mean_order'").withColumn("value", F.col("value").cast("decimal(18,2)"))
    target = f.where((F.col("symbol").cast("int") % 3 != 0) | (F.col("period") < "1997Q1"))
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    sent = op.export_snapshot(f.where("period >= '1996Q1'"), path, "metric")
    merged, _ = op.import_snapshot(target, path, ["symbol", "period", "metric"])
    after, before = op.manifest(merged, "metric"), op.manifest(target, "metric").select("part", F.col("n").alias("b"))
    j = sent.join(after.select("part", F.col("n").alias("after_n"), F.col("digest").alias("after_digest")), "part").join(before, "part")
    return j.select(F.col("part").alias("metric"), "n", "digest", "after_n", "after_digest", (F.col("after_n") - F.col("b")).alias("added"))


# ---------------------------------------------------------------- repairs

#: 1996 has rows with an impossible price, of which those of even symbols can be fetched again; 1997 has mock rows; 1998 has
#: sessions on a weekend; the other years are clean.
DIRTY = f"""{BARS}, dirty AS (SELECT symbol, session, open, CASE WHEN year(session) = 1996 AND (symbol::INT + month(session)) % 5 = 0 THEN -1::DOUBLE ELSE high END AS high, low, close, year(session) AS y,
  CASE WHEN year(session) = 1997 AND (symbol::INT + month(session)) % 4 = 0 THEN 'mock' ELSE 'exchange' END AS source FROM bars WHERE year(session) = 1998 OR dayofweek(session) NOT IN (0, 6)),
fl AS (SELECT *, CASE WHEN source = 'mock' THEN 'mock' WHEN dayofweek(session) IN (0, 6) THEN 'weekend' WHEN high < greatest(open, close, low) OR NOT high > 0 THEN 'invalid' END AS fault FROM dirty)"""


def dirty(spark, sf) -> DataFrame:
    s, y, m = F.col("symbol").cast("int"), F.year("session"), F.month("session")
    b = a.bars(spark, sf).where((y == 1998) | ~F.dayofweek("session").isin(1, 7))
    high = F.when((y == 1996) & ((s + m) % 5 == 0), F.lit(-1.0)).otherwise(F.col("high"))
    source = F.when((y == 1997) & ((s + m) % 4 == 0), "mock").otherwise("exchange")
    return b.select("symbol", "session", "open", high.alias("high"), "low", "close", y.alias("y"), source.alias("source"))


@query(
    "c18_hygiene_repairs", "y before removed repaired after total", "highest",
    f"""WITH {DIRTY}, t AS (SELECT y, count(*) AS before, count(fault) AS removed, count(*) FILTER (fault = 'invalid' AND symbol::INT % 2 = 0) AS repaired FROM fl GROUP BY 1 HAVING count(fault) > 0),
    done AS (SELECT f.y, CASE WHEN f.fault IS NULL THEN f.high ELSE b.high END AS high FROM fl f LEFT JOIN bars b ON b.symbol = f.symbol AND b.session = f.session AND f.fault = 'invalid' AND f.symbol::INT % 2 = 0 WHERE f.fault IS NULL OR b.symbol IS NOT NULL)
    SELECT d.y, t.before, t.removed, t.repaired, t.before - t.removed + t.repaired AS after, d.total, d.highest FROM (SELECT y, count(*) AS total, max(high) AS highest FROM done GROUP BY 1) d LEFT JOIN t USING (y)""",
)
def c18(spark, sf):
    path = f"{shared_dir(spark)}/hygiene-{uuid.uuid4().hex}"
    d = dirty(spark, sf)
    d.write.partitionBy("y").parquet(f"{path}/table")
    at = spark.read.schema(d.schema).parquet(f"{path}/table").select(*d.columns)
    even = a.bars(spark, sf).where(F.col("symbol").cast("int") % 2 == 0)
    fetched = even.select("symbol", "session", "open", "high", "low", "close", F.year("session").alias("y"), F.lit("exchange").alias("source"))
    report = op.repair_partitions(op.faults(at), f"{path}/table", f"{path}/quarantine", "y", fetched)
    left = spark.read.schema(d.schema).parquet(f"{path}/table").groupBy("y").agg(F.count("*").alias("total"), F.max("high").alias("highest"))
    return left.join(report, "y", "left")
