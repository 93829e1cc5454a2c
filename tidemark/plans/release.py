"""Availability audit, causes of gaps and the release gate; quotes in a provider's charset."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.functions.shared import staged
from tidemark.operators import release as op
from tidemark.sources import quotes

from .factors import NAMES, price_factors
from .registry import ADJ, BARS, CAL, FACTORS, FIN, VAL, query

# ---------------------------------------------------------------- X42, X46

#: Facts of a quarter with payloads of all kinds, by the sum of symbol and quarter: cut, published, stated, of another basis,
#: without a date, none, and with the date in the other form; some are known a second, or two, from what they say, or never.
FACTS = f"""{FIN}, k AS (SELECT *, symbol::INT + left(period, 4)::INT * 4 + right(period, 1)::INT AS k FROM fin WHERE metric = 'revenue'),
pl AS (SELECT *, CASE k % 7 WHEN 0 THEN '{{"available_time_basis": "{op.PUBLISHED}"' WHEN 1 THEN '{{"available_time_basis": "{op.PUBLISHED}", "pub_dates": ["' || available::VARCHAR || '", "x"]}}' WHEN 2 THEN '{{"available_time_basis": "{op.STATED}", "stat_date": "' || (available - 44)::VARCHAR || '"}}'
  WHEN 3 THEN '{{"available_time_basis": "other"}}' WHEN 4 THEN '{{"available_time_basis": "{op.PUBLISHED}", "pub_dates": []}}' WHEN 5 THEN NULL ELSE '{{"available_time_basis": "{op.PUBLISHED}", "pub_dates": ["' || strftime(available, '%Y%m%d') || '"]}}' END AS payload,
  CASE WHEN k % 13 <> 0 THEN (available + 1)::TIMESTAMP - INTERVAL 8 HOUR + CASE WHEN k % 11 = 0 THEN INTERVAL 2 SECOND WHEN k % 5 = 0 THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END END AS known FROM k),
au AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'malformed_payload' WHEN known IS NULL THEN 'missing_available_time' WHEN k % 7 IN (3, 5) THEN 'unsupported_basis' WHEN k % 7 = 4 THEN 'basis_fields_missing' WHEN k % 11 = 0 THEN 'available_time_mismatch' END AS anomaly FROM pl)"""


def facts(spark, sf) -> DataFrame:
    f = a.financials(spark, sf).where("metric = 'revenue'")
    k = F.col("symbol").cast("int") + F.substring("period", 1, 4).cast("int") * 4 + F.substring("period", -1, 1).cast("int")
    f, iso = f.withColumn("k", k), F.col("available").cast("string")
    published, stated = f'{{"available_time_basis": "{op.PUBLISHED}"', f'{{"available_time_basis": "{op.STATED}", "stat_date": "'
    m = F.col("k") % 7
    payload = (
        F.when(m == 0, published).when(m == 1, F.concat(F.lit(published + ', "pub_dates": ["'), iso, F.lit('", "x"]}'))).when(m == 2, F.concat(F.lit(stated), F.date_sub("available", 44).cast("string"), F.lit('"}')))
        .when(m == 3, '{"available_time_basis": "other"}').when(m == 4, published + ', "pub_dates": []}').when(m == 6, F.concat(F.lit(published + ', "pub_dates": ["'), F.date_format("available", "yyyyMMdd"), F.lit('"]}')))
    )
    late = F.when(F.col("k") % 11 == 0, F.expr("interval 2 seconds")).when(F.col("k") % 5 == 0, F.expr("interval 1 second")).otherwise(F.expr("interval 0 seconds"))
    known = F.date_add("available", 1).cast("timestamp_ntz") - F.expr("interval 8 hours") + late
    return f.select("symbol", "period", payload.alias("payload"), F.when(F.col("k") % 13 != 0, known).alias("available"))


@query("x42_availability_audit", "symbol period basis anomaly", "", f"WITH {FACTS} SELECT symbol, period, CASE WHEN k % 7 IN (0, 5) THEN '<missing>' WHEN k % 7 = 2 THEN '{op.STATED}' WHEN k % 7 = 3 THEN 'other' ELSE '{op.PUBLISHED}' END AS basis, anomaly FROM au")
def x42(spark, sf):
    return op.availability_audit(facts(spark, sf))


@query("x42_anomaly_counts", "anomaly n", "", f"WITH {FACTS} SELECT c.anomaly, count(u.k) AS n FROM (VALUES {', '.join(f"('{c}')" for c in (*op.ANOMALIES, 'none'))}) c(anomaly) LEFT JOIN (SELECT k, coalesce(anomaly, 'none') AS anomaly FROM au) u USING (anomaly) GROUP BY 1")
def x42_counts(spark, sf):
    return op.anomaly_counts(op.availability_audit(facts(spark, sf)))


LEAST, SECTIONS = 0.9, 0.9
AUDITS = f"""{FACTS.replace(FIN, FIN + ", " + FACTORS + ", " + VAL)},
gp AS (SELECT count(*) FILTER (a.symbol IS NULL) AS without_factor, count(*) FILTER (b.symbol IS NULL) AS without_bar FROM bars b FULL JOIN (SELECT * FROM adj WHERE session < (SELECT max(session) FROM bars)) a ON a.symbol = b.symbol AND a.session = b.session),
fi AS (SELECT (SELECT count(DISTINCT symbol) FROM au WHERE anomaly IS NULL) / (SELECT count(DISTINCT symbol) FROM val)::DOUBLE AS coverage, (SELECT count(*) FROM au WHERE anomaly IS NOT NULL) AS anomalies),
va AS (SELECT count(*) FILTER (pe > 0) AS positive, 0 AS valuation_anomalies FROM val),
se AS (SELECT {", ".join(f"count(DISTINCT session) FILTER ({f} IS NOT NULL) / count(DISTINCT session)::DOUBLE AS {f}" for f in NAMES)} FROM pf),
st AS (SELECT factor, 'price' AS family, CASE WHEN share >= {SECTIONS} THEN 'sufficient' ELSE 'insufficient' END AS status FROM (UNPIVOT se ON {", ".join(NAMES)} INTO NAME factor VALUE share)
  UNION ALL VALUES ('roe_growth', 'financial', 'insufficient'), ('pe_percentile', 'valuation', 'insufficient'), ('live_depth', 'price', 'live_only'), ('net_inflow_5d', 'flow', 'history_excluded_pit_gap')),
ad AS (SELECT * FROM gp, fi, va)"""


def audits(spark, sf) -> DataFrame:
    """One row of all audits."""
    b = a.bars(spark, sf)
    last = b.agg(F.max("session").alias("__last"))
    adj = a.adjustments(b).crossJoin(F.broadcast(last)).where("session < __last").drop("__last")  # one row
    checked = op.availability_audit(facts(spark, sf))
    v = a.valuations(spark, sf)
    financial = checked.agg(F.countDistinct(F.when(F.col("anomaly").isNull(), F.col("symbol"))).alias("__have"), F.count("anomaly").alias("anomalies"))
    valuation = v.agg(F.countDistinct("symbol").alias("__all"), F.count_if(F.col("pe") > 0).alias("positive"), F.lit(0).alias("valuation_anomalies"))
    one = op.key_gaps(b, adj).crossJoin(F.broadcast(financial)).crossJoin(F.broadcast(valuation))  # one row each
    return one.withColumn("coverage", F.col("__have") / F.col("__all")).drop("__have", "__all")


@query("x46_gap_causes", "factor family status cause", "", f"""WITH {AUDITS} SELECT factor, family, status, CASE WHEN status = 'sufficient' THEN NULL WHEN status IN ('live_only', 'history_excluded_pit_gap') THEN status
  WHEN family = 'financial' AND coverage < {LEAST}::DOUBLE THEN 'input_data_gap' WHEN family = 'financial' AND anomalies > 0 THEN 'pit_data_error' WHEN family = 'valuation' AND positive = 0 THEN 'input_data_gap'
  WHEN family = 'price' AND (without_factor > 0 OR without_bar > 0) THEN 'input_data_gap' ELSE 'suspected_factor_path_bug' END AS cause FROM st, ad""")  # fmt: skip
def x46_causes(spark, sf):
    p = price_factors(spark, sf)
    shares = p.agg(*((F.countDistinct(F.when(F.col(f).isNotNull(), F.col("session"))) / F.countDistinct("session")).alias(f) for f in NAMES))
    price = shares.unpivot([], NAMES, "factor", "share").select("factor", F.lit("price").alias("family"), F.when(F.col("share") >= SECTIONS, "sufficient").otherwise("insufficient").alias("status"))
    rest = [("roe_growth", "financial", "insufficient"), ("pe_percentile", "valuation", "insufficient"), ("live_depth", "price", "live_only"), ("net_inflow_5d", "flow", "history_excluded_pit_gap")]
    return op.causes(price.union(spark.createDataFrame(rest, price.schema)), staged(audits(spark, sf), "audits"), LEAST)


@query("x46_release_gate", "code kind failed ready", "value", f"""WITH {AUDITS}, r AS (SELECT unnest([
  {{'code': 'factor_keys', 'kind': 'blocker', 'value': without_factor::DOUBLE, 'failed': without_factor > 0}}, {{'code': 'bar_keys', 'kind': 'blocker', 'value': without_bar::DOUBLE, 'failed': without_bar > 0}},
  {{'code': 'repeated_bars', 'kind': 'blocker', 'value': 0::DOUBLE, 'failed': false}}, {{'code': 'financial_coverage', 'kind': 'blocker', 'value': coverage, 'failed': coverage < {LEAST}::DOUBLE}},
  {{'code': 'availability', 'kind': 'warning', 'value': anomalies::DOUBLE, 'failed': anomalies > 0}}, {{'code': 'valuations', 'kind': 'warning', 'value': positive::DOUBLE, 'failed': positive = 0}}], recursive := true) FROM ad)
  SELECT *, NOT bool_or(failed AND kind = 'blocker') OVER () AS ready FROM r""")  # fmt: skip
def x46_gate(spark, sf):
    c = F.col
    rules = [
        ("factor_keys", "blocker", c("without_factor"), c("without_factor") > 0), ("bar_keys", "blocker", c("without_bar"), c("without_bar") > 0), ("repeated_bars", "blocker", c("repeated"), c("repeated") > 0),
        ("financial_coverage", "blocker", c("coverage"), c("coverage") < LEAST), ("availability", "warning", c("anomalies"), c("anomalies") > 0), ("valuations", "warning", c("positive"), c("positive") == 0),
    ]
    return op.gate(audits(spark, sf), rules)


# ---------------------------------------------------------------- S8


def responses(spark, sf) -> DataFrame:
    """(path, content): a response for each session with a line for each bar, in the provider's charset; some lines are cut."""
    b = a.bars(spark, sf)
    s = F.col("symbol").cast("int")
    fields = F.concat_ws(",", F.concat(F.lit("证券"), "symbol"), F.floor("open").cast("string"), F.lit("-"), F.floor("close").cast("string"), F.lit("x"), F.lit("0"), F.lit("1"), F.lit("2"), F.col("volume").cast("long").cast("string"), F.lit("7"))
    timed = F.concat(fields, F.lit("," * 20), F.lit(","), F.date_format("session", "yyyy-MM-dd"), F.lit(",15:00:00"))
    body = F.when(s % 5 == 0, fields).when(s % 7 == 0, F.lit("short,1")).otherwise(timed)
    line = F.concat(F.lit("var hq_str_bj"), "symbol", F.lit('="'), body, F.lit('";'))
    text = b.select(F.col("session").cast("string").alias("path"), line.alias("line")).groupBy("path").agg(F.array_join(F.collect_list("line"), "\n").alias("text"))

    def encode(batches):
        for x in batches:
            yield pa.record_batch([x.column(0), pa.array([t.encode(quotes.CHARSET) for t in x.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    return text.mapInArrow(encode, "path string, content binary")


@query(
    "s8_provider_quotes", "path symbol name quoted", "open last high volume",
    f"""WITH {BARS} SELECT session::VARCHAR AS path, symbol, '证券' || symbol AS name, floor(open) AS open, floor(close) AS last, NULL::DOUBLE AS high, volume::BIGINT::DOUBLE AS volume,
    CASE WHEN symbol::INT % 5 <> 0 THEN strftime(session::TIMESTAMP + INTERVAL 15 HOUR, '%Y-%m-%d %H:%M:%S') END AS quoted FROM bars WHERE symbol::INT % 5 = 0 OR symbol::INT % 7 <> 0""",
)
def s8(spark, sf):
    return quotes.snapshot(quotes.decoded(responses(spark, sf))).withColumn("quoted", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "s8_factor_intervals", "symbol session", "adj_factor",
    f"""WITH {BARS}, {ADJ}, ev AS (SELECT symbol, session AS day, adj_factor + month(session) / 100.0::DOUBLE AS f FROM adj WHERE month(session) % 4 = 0)
    SELECT b.symbol, b.session, (SELECT arg_max(f, day) FROM ev WHERE ev.symbol = b.symbol AND ev.day <= b.session) AS adj_factor FROM bars b""",
)
def s8_factors(spark, sf):
    b = a.bars(spark, sf)
    e = a.adjustments(b).where(F.month("session") % 4 == 0).select("symbol", F.col("session").alias("day"), (F.col("adj_factor") + F.month("session") / 100).alias("adj_factor"))
    return quotes.factors_of(b, quotes.factor_intervals(e))
