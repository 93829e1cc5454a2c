"""Scans, failover and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.functions.clean import audited, cutoff, finite, local_seconds, market_open, visible
from tidemark.sources import merge, scan

from .registry import BARS, TICKS, query

SRC = "CASE symbol::INT % 4 WHEN 0 THEN 'mock' WHEN 1 THEN 'exchange' WHEN 2 THEN 'vendor_a' ELSE 'vendor_b' END"
TARGET = f"{BARS}, tgt AS (SELECT symbol, session, close, {SRC} AS source FROM bars WHERE month(session) % 3 <> 0), nw AS (SELECT symbol, session, close + CASE WHEN month(session) % 2 = 0 THEN 1 ELSE 0 END AS close, 'exchange' AS source FROM bars WHERE year(session) >= 1998)"


def source_col():
    k = F.col("symbol").cast("int") % 4
    return F.when(k == 0, "mock").when(k == 1, "exchange").when(k == 2, "vendor_a").otherwise("vendor_b")


def target(spark, sf):
    b = a.bars(spark, sf)
    t = b.where(F.month("session") % 3 != 0).select("symbol", "session", "close", source_col().alias("source"))
    n = b.where(F.year("session") >= 1998).select("symbol", "session", (F.col("close") + F.when(F.month("session") % 2 == 0, 1.0).otherwise(0.0)).alias("close"), F.lit("exchange").alias("source"))
    return t, n


KEYS = ["symbol", "session"]


@query("s1_audited_scan", "symbol session source", "close", f"WITH {TARGET} SELECT * FROM tgt WHERE source IN ('exchange', 'vendor_a', 'vendor_b') AND session BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
def s1(spark, sf):
    return audited(target(spark, sf)[0]).where(F.col("session").between("1997-01-01", "1999-12-31"))


@query("s2_strict_scan", "source n", "", f"WITH {TARGET} SELECT source, count(*) AS n FROM tgt WHERE source <> 'mock' GROUP BY 1")
def s2(spark, sf):
    return scan.strict(target(spark, sf)[0].where("source <> 'mock'")).groupBy("source").agg(F.count("*").alias("n"))


@query("s4_failover", "symbol session provider", "close", f"WITH {TARGET} SELECT coalesce(t.symbol, n.symbol) AS symbol, coalesce(t.session, n.session) AS session, CASE WHEN t.symbol IS NULL THEN 1 ELSE 0 END AS provider, coalesce(t.close, n.close) AS close FROM tgt t FULL JOIN nw n ON t.symbol = n.symbol AND t.session = n.session")
def s4(spark, sf):
    return scan.failover(list(target(spark, sf)), KEYS)


@query("s18_insert_or_repair", "symbol session source", "close", f"WITH {TARGET} SELECT symbol, session, close, source FROM tgt ANTI JOIN (SELECT n.* FROM nw n JOIN tgt t ON t.symbol = n.symbol AND t.session = n.session WHERE t.source = 'mock') r USING (symbol, session) UNION ALL SELECT n.symbol, n.session, n.close, n.source FROM nw n LEFT JOIN tgt t ON t.symbol = n.symbol AND t.session = n.session WHERE t.symbol IS NULL OR t.source = 'mock'")
def s18(spark, sf):
    t, n = target(spark, sf)
    once = merge.insert_or_repair(t, n, KEYS)
    return merge.insert_or_repair(once, n, KEYS)


@query("s19_upsert_changed", "symbol session source", "close", f"WITH {TARGET} SELECT coalesce(t.symbol, n.symbol) AS symbol, coalesce(t.session, n.session) AS session, CASE WHEN n.symbol IS NOT NULL AND (t.symbol IS NULL OR abs(n.close - t.close) > 1e-12) THEN n.close ELSE t.close END AS close, CASE WHEN n.symbol IS NOT NULL AND (t.symbol IS NULL OR abs(n.close - t.close) > 1e-12) THEN n.source ELSE t.source END AS source FROM tgt t FULL JOIN nw n ON t.symbol = n.symbol AND t.session = n.session")
def s19(spark, sf):
    return merge.upsert_changed(*target(spark, sf), KEYS, "close")


@query("s21_insert_absent", "symbol session source", "close", f"WITH {TARGET} SELECT * FROM tgt UNION ALL SELECT n.* FROM nw n ANTI JOIN tgt USING (symbol, session)")
def s21(spark, sf):
    return merge.insert_absent(*target(spark, sf), KEYS)


@query("s22_keep_earliest", "symbol source session", "close", f"WITH {TARGET}, t1 AS (SELECT symbol, max(session) AS session, arg_max(close, session) AS close, any_value(source) AS source FROM tgt GROUP BY 1), n1 AS (SELECT symbol, min(session) AS session, arg_min(close, session) AS close, any_value(source) AS source FROM nw GROUP BY 1) SELECT n.symbol, n.source, least(t.session, n.session) AS session, n.close FROM n1 n JOIN t1 t USING (symbol)")
def s22(spark, sf):
    t, n = target(spark, sf)
    t1 = t.groupBy("symbol").agg(F.max("session").alias("session"), F.max_by("close", "session").alias("close"), F.first("source").alias("source"))
    n1 = n.groupBy("symbol").agg(F.min("session").alias("session"), F.min_by("close", "session").alias("close"), F.first("source").alias("source"))
    return merge.keep_earliest(t1, n1, ["symbol"], "session")


@query("s23_by_priority", "symbol session source", "close", f"WITH {TARGET}, a AS (SELECT *, 0 AS nn FROM tgt UNION ALL SELECT *, 1 FROM nw) SELECT symbol, session, source, close FROM a QUALIFY row_number() OVER (PARTITION BY symbol, session ORDER BY (source = 'exchange')::INT DESC, nn) = 1")
def s23(spark, sf):
    return merge.by_priority(*target(spark, sf), KEYS, F.desc((F.col("source") == "exchange").cast("int")))


@query("x40_migration_check", "missing extra changed keys", "", f"WITH {TARGET} SELECT count(*) FILTER (n.symbol IS NULL) AS missing, count(*) FILTER (t.symbol IS NULL) AS extra, count(*) FILTER (abs(t.close - n.close) > 1e-9 * greatest(abs(t.close), abs(n.close))) AS changed, count(*) AS keys FROM tgt t FULL JOIN nw n ON t.symbol = n.symbol AND t.session = n.session")
def x40(spark, sf):
    return merge.migration_check(*target(spark, sf), KEYS, "close")


@query("f32_f33_json_and_time", "event_id k seconds open", "", f"WITH {TICKS} SELECT event_id, (props->>'$.k')::BIGINT AS k, (hour(l) * 3600 + minute(l) * 60 + floor(second(l)))::INTEGER AS seconds, isodow(l) <= 5 AND hour(l) * 3600 + minute(l) * 60 + floor(second(l)) BETWEEN 33900 AND 54300 AS open FROM (SELECT *, ts + INTERVAL 8 HOUR AS l FROM ticks)")
def f32(spark, sf):
    t = a.ticks(spark, sf)
    ts = F.col("ts").cast("timestamp")
    return t.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), local_seconds(ts).cast("int").alias("seconds"), market_open(ts).alias("open"))


@query("r2_visible_asof", "event_type n", "total", f"WITH {TICKS} SELECT event_type, count(*) AS n, sum(value) AS total FROM ticks WHERE ts <= TIMESTAMP '2024-01-15 11:30:00' GROUP BY 1")
def r2(spark, sf):
    t = a.ticks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", finite(F.col("value")))
    return visible(t, "ts", cutoff(F.lit("2024-01-15"))).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
