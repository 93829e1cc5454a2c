"""Bars of the star-schema lines."""

import datetime as dt

from pyspark.sql import functions as F
from tidemark import adapters

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"


def test_bars_shuffle_lines_once_and_make_no_partial_bars(spark):
    """Partial bars before the shuffle are wider than lines and need whole splits to be sorted, which spills."""
    at = dt.datetime(2000, 1, 5)
    rows = [(2, 1, 7, 1, 2.0, 20.0, at), (1, 1, 7, 2, 1.0, 30.0, at), (1, 1, 7, 1, 4.0, 8.0, at), (9, 1, 7, 1, 1.0, 5.0, dt.datetime(2000, 1, 9)), (3, 1, 1234567, 1, 1.0, 1.0, at), (4, 1, 1234568, 1, 1.0, 2.0, at)]
    bars = adapters._ohlc(spark.createDataFrame(rows, LINES), F.trunc("l_shipdate", "month"))
    plan = bars._jdf.queryExecution().executedPlan().toString()
    got = {r["symbol"]: tuple(r)[1:] for r in bars.collect()}
    assert got == {"000007": (dt.date(2000, 1, 1), 2.0, 30.0, 2.0, 5.0, 8.0, 63.0), "123456": (dt.date(2000, 1, 1), 1.0, 2.0, 1.0, 2.0, 2.0, 3.0)}
    assert plan.count("Exchange") == 1 and plan.rindex("Aggregate") < plan.index("Exchange")


def test_read_through_bars_sum_the_lines_up_once(spark):
    from tidemark import plans

    plan = plans.QUERIES["x21_read_through_bars"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "Join" in plan
