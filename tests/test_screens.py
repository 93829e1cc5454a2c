"""The screen's filters, the gate, and bars of a table that changes."""

import shutil

import pytest
from pyspark.sql import functions as F
from tidemark import adapters
from tidemark.operators import pit, screens

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def market(spark):
    nan = float("nan")
    scored = [(f"s{i}", "d1", float(i), 0.1 * i if i % 2 else None, float(i)) for i in range(9)] + [("s0", "d2", 1.0, None, None), ("s9", "d1", nan, None, 0.5)]
    secs = [(f"s{i}", " A " if i % 2 else "B", float(i) if i != 3 else nan, "growth" if i > 4 else None, i != 7, i == 8) for i in range(10)]
    return (
        spark.createDataFrame(scored, "symbol string, session string, score double, expected double, volatility double"),
        spark.createDataFrame(secs, "symbol string, industry string, cap double, style string, listed boolean, is_st boolean"),
    )


def names(df):
    return sorted((r["session"], r["symbol"]) for r in df.collect())


def test_filters(spark, market):
    scored, secs = market
    d1 = lambda *k: [("d1", f"s{i}") for i in k]
    assert names(screens.filtered(scored, secs)) == d1(0, 1, 2, 3, 4, 5, 6) + [("d2", "s0")]
    assert names(screens.filtered(scored, secs, industries=["A ", ""])) == d1(1, 3, 5)
    assert names(screens.filtered(scored, secs, least_cap=2)) == d1(2, 4, 5, 6)
    assert names(screens.filtered(scored, secs, style="growth")) == d1(5, 6)
    one = scored.where("session = 'd1'")
    # thirds of all ten volatilities, whether or not their symbols are left: 2 and 5
    assert names(screens.filtered(one, secs, risk="low")) == d1(0, 1, 2) and names(screens.filtered(one, secs, risk="mid")) == d1(3, 4, 5) and names(screens.filtered(one, secs, risk="high")) == d1(6)
    assert names(screens.filtered(scored, secs, watchlist=spark.createDataFrame([("s2",), ("s2",), ("zz",)], "symbol string"))) == d1(2)
    assert {r["style"] for r in screens.filtered(scored, secs, style="growth", style_is_current=False).collect()} == {None}
    got = [(r["session"], r["rank"], r["symbol"]) for r in screens.best(screens.filtered(scored, secs), 2).orderBy("session", "rank").collect()]
    assert got == [("d1", 1, "s5"), ("d1", 2, "s3"), ("d2", 1, "s0")]


def test_filters_that_cannot_be_met_are_errors(spark, market):
    scored, secs = market
    with pytest.raises(ValueError):
        screens.filtered(scored, secs, industries=[" "])
    with pytest.raises(ValueError):
        screens.filtered(scored, secs, risk="medium")
    with pytest.raises(Exception, match="no volatility"):
        screens.filtered(scored.where("session = 'd2'"), secs, risk="low").collect()


def test_gate(spark):
    rows = spark.createDataFrame([("d1", 1.0), ("d1", None), ("d2", 1.0), ("d2", 1.0), ("d3", None)], "session string, score double")
    assert sorted({r["session"] for r in screens.gated(rows, "score", 0.5).collect()}) == ["d1", "d2"]
    assert screens.gated(rows, "score", 0.51).count() == 2


def test_bars_follow_their_table(spark, tmp_path):
    shutil.copy(f"{SF}/lineitem.parquet", tmp_path / "lineitem.parquet")
    first = adapters.bars(spark, str(tmp_path))
    n, path = first.count(), first.inputFiles()[0]
    assert adapters.bars(spark, str(tmp_path)).inputFiles()[0] == path  # staged once
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    rows.unionByName(rows.limit(1).withColumn("l_suppkey", F.lit(777).cast("long"))).coalesce(1).write.parquet(str(tmp_path / "new"))
    (tmp_path / "lineitem.parquet").unlink()
    (tmp_path / "new").rename(tmp_path / "lineitem.parquet")
    again = adapters.bars(spark, str(tmp_path))
    assert again.count() == n + 1 and again.where("symbol = '000777'").count() == 1


def test_nearest_keeps_equal_rows(spark):
    left = spark.createDataFrame([("a", 10, 1), ("a", 10, 1), ("a", 10, 2), ("b", 10, 1), (None, 10, 1)], "k string, s long, v int").withColumn("t", F.timestamp_seconds("s"))
    right = spark.createDataFrame([("a", 8, 5), ("a", 12, 6), ("b", 99, 7)], "k string, s long, w int").select("k", F.timestamp_seconds("s").alias("t"), "w")
    got = sorted((r["k"] or "", r["v"], r["w_near"]) for r in pit.nearest(left, right, ["k"], "t", 5).collect())
    assert got == [("", 1, None), ("a", 1, 5), ("a", 1, 5), ("a", 2, 5), ("b", 1, None)]


def test_the_leader_of_a_window(spark):
    import datetime as dt

    from tidemark.operators import sectors

    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    path = {"b": [1, 2, 1, 3], "up": [1, 2, 1, 3], "like": [2, 4, 2, 5], "anti": [4, 2, 4, 2], "flat": [1, 1, 1, 1], "gap": [1, None, 9, 99], "solo": [1, 2, 3, 9]}
    rows = [(s, day(i), float(c)) for s, p in path.items() for i, c in enumerate(p) if c is not None] + [("up", day(-1), 50.0), ("b", day(-1), 1.0)]
    bars = spark.createDataFrame(rows, "symbol string, session date, close double")
    plates = spark.createDataFrame([("p", s) for s in ("like", "anti", "up", "flat", "gap")] + [("q", "solo"), ("q", "flat")], "plate string, symbol string")
    got = sectors.window_leaders(bars, plates, "b", 3).orderBy("rank").collect()
    assert [(r["plate"], r["rank"], r["symbol"], r["leader"], r["n"]) for r in got] == [("p", 1, "like", "up", 3), ("p", 2, "anti", "up", 3)]
    assert got[0]["total"] == 1.5 and got[0]["corr"] > 0.9 > -0.8 > got[1]["corr"]
    assert sectors.window_leaders(bars, plates, "b", 5).count() == 0
