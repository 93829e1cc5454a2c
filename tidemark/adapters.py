"""Roles of the available tables: what the operators know as bars, factors, valuations, ticks and so on.

Every adapter is a plain DataFrame over the star-schema tables; ``plans.sql`` has the same definitions as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shared import discard, stage, version

#: The staged bars of each application and table, with the version of the table that they were made from.
_BARS: dict[tuple[str, str], tuple[tuple, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol(col: str):
    """Six-digit form of a key."""
    return F.lpad(F.col(col).cast("string"), 6, "0")


def _ohlc(lines: DataFrame, session) -> DataFrame:
    """Bars of a supplier's lines. Few lines share a bar, and those lie apart, so each line is shuffled once, narrow and as it is:
    partial bars before the shuffle would be wider than the lines, and be made by sorting whole splits of the file."""
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    narrow = lines.select(symbol("l_suppkey").alias("symbol"), session.alias("session"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    priced = narrow.repartition("symbol", "session").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    return priced.groupBy("symbol", "session").agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("amount"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, session, open, high, low, close, volume, amount): a session is a month of a supplier's lines.

    Summed up once for each version of the table and written to the shared folder: a query refers to the bars several times,
    for the calendar, the factors and the execution prices, with different columns each, so Spark would else scan the lines
    each time. When the table's files have changed, the bars are made anew and those of before are removed.
    """
    key, now = (spark.sparkContext.applicationId, sf_dir), version(spark, f"{sf_dir}/lineitem.parquet")
    if key not in _BARS or _BARS[key][0] != now:
        path = stage(_ohlc(table(spark, sf_dir, "lineitem"), F.trunc("l_shipdate", "month")), "bars")
        if key in _BARS:
            discard(spark, _BARS[key][1])
        _BARS[key] = now, path
    return spark.read.parquet(_BARS[key][1])


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by day: sparse, most symbols rest on most days."""
    return _ohlc(table(spark, sf_dir, "lineitem"), F.to_date("l_shipdate"))


def adjustments(bar: DataFrame) -> DataFrame:
    """(symbol, session, adj_factor): 1.0 before 1998, 1.1 from then on, missing for one key in thirteen."""
    key = F.col("symbol").cast("int") + F.year("session") * 12 + F.month("session")
    step = F.when(F.col("session") >= F.lit("1998-01-01").cast("date"), 1.1).otherwise(1.0)
    return bar.where(key % 13 != 0).select("symbol", "session", step.alias("adj_factor"))


def plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plate, symbol): the nation of a supplier."""
    return table(spark, sf_dir, "supplier").select(F.format_string("N%02d", "s_nationkey").alias("plate"), symbol("s_suppkey").alias("symbol"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plate, session, flow): amounts of members that closed at or above their open, less those of the others; one plate has
    none."""
    signed = F.when(F.col("close") >= F.col("open"), F.col("amount")).otherwise(-F.col("amount"))
    j = bars(spark, sf_dir).join(plates(spark, sf_dir), "symbol").where("plate <> 'N07'")
    return j.groupBy("plate", "session").agg(F.sum(signed).alias("flow"))


def financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, period, metric, value, available): order statistics of a customer's quarter, known 45 days after its end."""
    o = table(spark, sf_dir, "orders").select(symbol("o_custkey").alias("symbol"), F.trunc("o_orderdate", "quarter").alias("q"), "o_totalprice")
    per = o.groupBy("symbol", "q").agg(F.sum("o_totalprice").alias("revenue"), F.avg("o_totalprice").alias("mean_order"), F.count("*").cast("double").alias("orders"))
    long = per.unpivot(["symbol", "q"], ["revenue", "mean_order", "orders"], "metric", "value")
    period = F.concat(F.year("q").cast("string"), F.lit("Q"), F.quarter("q").cast("string"))
    available = F.date_add(F.add_months("q", 3), 44)
    return long.select("symbol", period.alias("period"), "metric", "value", available.alias("available"))


def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, nation, pe, pb): ratios of a customer; balances may be zero or negative, and so may the ratios."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("p"), F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer")
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    pe = F.try_divide(F.col("p"), F.nullif(F.col("c_acctbal"), F.lit(0.0)))
    return j.select(symbol("c_custkey").alias("symbol"), F.col("c_nationkey").alias("nation"), "c_mktsegment", F.col("c_acctbal").alias("cap"), pe.alias("pe"), (pe * F.col("n")).alias("pb"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, symbol, event_type, value, props) from the event stream; times are UTC."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), symbol("user_id").alias("symbol"), "event_type", "value", "props")
