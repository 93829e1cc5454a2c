"""Is the data fit to be used: availability against what payloads say, causes of gaps, and a gate of blockers and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import ZONE

# fixed values: bases of an availability, the days after a statement, classes of anomalies
PUBLISHED, STATED = "provider_pub_date_end_of_day", "stat_date_plus_45_days"
DAYS = 45
ANOMALIES = ("malformed_payload", "missing_available_time", "unsupported_basis", "basis_fields_missing", "available_time_mismatch")


def day(text: Column) -> Column:
    """An ISO date, with or without dashes; null for anything else."""
    t = F.trim(text)
    t = F.when(t.rlike("^[0-9]{8}$"), F.regexp_replace(t, "^(....)(..)(..)$", "$1-$2-$3")).otherwise(t)
    return F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t.try_cast("date"))


def expected(payload: Column) -> Column:
    """When a payload says that its fact was known, as UTC without a zone: local midnight after the first publication day, or 45
    days after the statement's."""
    basis = F.get_json_object(payload, "$.available_time_basis")
    known = F.when(basis == PUBLISHED, F.date_add(day(F.get_json_object(payload, "$.pub_dates[0]")), 1)).when(basis == STATED, F.date_add(day(F.get_json_object(payload, "$.stat_date")), DAYS))
    return F.convert_timezone(F.lit(ZONE), F.lit("UTC"), known.cast("timestamp_ntz"))


def availability_audit(facts: DataFrame, seconds: int = 1) -> DataFrame:
    """facts (payload, available, ...) with basis (`<missing>` without one) and anomaly: the first of ANOMALIES that holds, else
    null. A null payload is an empty one; one that is no JSON object is malformed; up to `seconds` may lie between the two
    times."""
    parsed = F.try_parse_json(F.col("payload"))
    bad = F.col("payload").isNotNull() & ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    d = facts.withColumn("__bad", bad).withColumn("__p", F.when(~F.col("__bad"), F.col("payload")))
    d = d.withColumn("basis", F.coalesce(F.nullif(F.get_json_object("__p", "$.available_time_basis"), F.lit("")), F.lit("<missing>"))).withColumn("__e", expected(F.col("__p")))
    off = F.abs(F.unix_micros(F.col("available").cast("timestamp")) - F.unix_micros(F.col("__e").cast("timestamp"))) > seconds * 1_000_000
    anomaly = (
        F.when(F.col("__bad"), ANOMALIES[0]).when(F.col("available").isNull(), ANOMALIES[1]).when(~F.col("basis").isin(PUBLISHED, STATED), ANOMALIES[2])
        .when(F.col("__e").isNull(), ANOMALIES[3]).when(off, ANOMALIES[4])
    )
    return d.withColumn("anomaly", anomaly).drop("__bad", "__p", "__e")


def anomaly_counts(audited: DataFrame) -> DataFrame:
    """(anomaly, n): every class has a row, the clean rows are `none`."""
    every = audited.sparkSession.createDataFrame([(a,) for a in (*ANOMALIES, "none")], "anomaly string")
    n = audited.groupBy(F.coalesce("anomaly", F.lit("none")).alias("anomaly")).agg(F.count("*").alias("n"))
    return every.join(F.broadcast(n), "anomaly", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # a row a class


def key_gaps(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """One row: bars without a factor, factors without a bar, and keys of bars that occur more than once."""
    b = bars.groupBy("symbol", "session").agg(F.count("*").alias("__b"))
    f = factors.select("symbol", "session").distinct().withColumn("__f", F.lit(1))
    j = b.join(f, ["symbol", "session"], "full")
    return j.agg(F.count_if(F.col("__f").isNull()).alias("without_factor"), F.count_if(F.col("__b").isNull()).alias("without_bar"), F.count_if(F.col("__b") > 1).alias("repeated"))


def causes(status: DataFrame, audits: DataFrame, least: float) -> DataFrame:
    """status (factor, family, status) with cause: why a factor has too few cross-sections. audits is one row: coverage,
    anomalies, positive, valuation_anomalies, without_factor, without_bar. A gap that the inputs don't explain is suspected to
    be a fault of the factor's own path."""
    d = status.crossJoin(F.broadcast(audits))  # one row
    financial = F.when(F.coalesce(F.col("coverage") < least, F.lit(True)), "input_data_gap").when(F.col("anomalies") > 0, "pit_data_error")
    valuation = F.when(F.col("positive") == 0, "input_data_gap").when(F.col("valuation_anomalies") > 0, "pit_data_error")
    price = F.when((F.col("without_factor") > 0) | (F.col("without_bar") > 0), "input_data_gap")
    found = F.when(F.col("family") == "financial", financial).when(F.col("family") == "valuation", valuation).when(F.col("family") == "price", price)
    cause = F.when(F.col("status") == "sufficient", None).when(F.col("status").isin("live_only", "history_excluded_pit_gap", "probe_error"), F.col("status")).otherwise(F.coalesce(found, F.lit("suspected_factor_path_bug")))
    return d.withColumn("cause", cause).select(*status.columns, "cause")


def gate(audits: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """(code, kind, value, failed, ready) of each rule (code, blocker or warning, value, fails if) over one row of audits; ready
    is whether no blocker fails. All audits are parts of one plan."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.lit(k).alias("kind"), v.cast("double").alias("value"), F.coalesce(f, F.lit(True)).alias("failed")) for c, k, v, f in rules)))
    blocked = [F.coalesce(f, F.lit(True)) for _, k, _, f in rules if k == "blocker"]
    ready = F.lit(True)
    for b in blocked:
        ready = ready & ~b
    return audits.select(ready.alias("ready"), each.alias("r")).select("r.*", "ready")
