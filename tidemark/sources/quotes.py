"""Quotes and factor events as a provider sends them: bytes in a charset of its own, one assignment a line."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import finite

CHARSET = "gb18030"
# fixed values: the line of a quote, and the places of its fields
LINE = '^\\s*var\\s+hq_str_([a-z]{2})([0-9]{6})="([^"]*)"'
FIELDS = {"open": 1, "previous": 2, "last": 3, "high": 4, "low": 5, "volume": 8, "amount": 9}
LEAST, DATE, TIME = 10, 30, 31


def decoded(raw: DataFrame, charset: str = CHARSET, column: str = "content") -> DataFrame:
    """raw (path, content) as (path, text): Spark's own functions don't decode this charset; bytes that it does not have are
    U+FFFD."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([None if x is None else x.decode(charset, "replace") for x in b.column(1).to_pylist()], pa.string())], names=["path", "text"])

    return raw.select("path", column).mapInArrow(run, "path string, text string")


def snapshot(texts: DataFrame) -> DataFrame:
    """(path, market, symbol, name, prices, at) of the lines that are quotes with at least ten fields and a name; numbers that are
    none are null, and so is a time that is none."""
    lines = texts.select("path", F.explode(F.split("text", "\\r\\n|[\\n\\r]")).alias("line"))
    d = lines.where(F.col("line").rlike(LINE)).select("path", *(F.regexp_extract("line", LINE, i).alias(n) for i, n in ((1, "market"), (2, "symbol"), (3, "body"))))
    d = d.withColumn("f", F.split("body", ",")).where((F.size("f") >= LEAST) & (F.trim(F.get("f", F.lit(0))) != ""))
    at = F.concat_ws(" ", F.get("f", F.lit(DATE)), F.get("f", F.lit(TIME))).try_cast("timestamp_ntz")
    numbers = [finite(F.get("f", F.lit(i))).alias(n) for n, i in FIELDS.items()]
    return d.select("path", "market", "symbol", F.trim(F.get("f", F.lit(0))).alias("name"), *numbers, F.when(F.size("f") > TIME, at).alias("at"))


def factor_intervals(events: DataFrame) -> DataFrame:
    """(symbol, since, until, adj_factor) from events (symbol, day, adj_factor): each factor holds from its day to the day before
    the next one, the last without an end. Factors that are not positive numbers are skipped; of a repeated day the larger
    counts."""
    ok = events.select("symbol", "day", finite(F.col("adj_factor")).alias("adj_factor")).where("day IS NOT NULL AND adj_factor > 0")
    one = ok.groupBy("symbol", "day").agg(F.max("adj_factor").alias("adj_factor"))
    return one.select("symbol", F.col("day").alias("since"), F.date_sub(F.lead("day").over(Window.partitionBy("symbol").orderBy("day")), 1).alias("until"), "adj_factor")


def factors_of(bars: DataFrame, intervals: DataFrame) -> DataFrame:
    """(symbol, session, adj_factor) of each bar: the factor of the interval that it lies in; null before the first."""
    i = intervals.withColumnRenamed("symbol", "of")
    inside = (F.col("symbol") == F.col("of")) & (F.col("session") >= F.col("since")) & (F.col("until").isNull() | (F.col("session") <= F.col("until")))
    return bars.select("symbol", "session").join(i, inside, "left").select("symbol", "session", "adj_factor")
