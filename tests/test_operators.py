"""Hand-worked cases of the operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tidemark.functions import clean, stats
from tidemark.operators import backtest, factors, health, market, metrics, pit, sectors, text
from tidemark.sources import merge, scan
from tidemark.streaming import jobs

D = dt.date


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def close(got, want, tol=1e-6):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            assert a == b or (isinstance(b, float) and isinstance(a, float) and math.isclose(a, b, abs_tol=tol)), (g, w)


def test_winsor_zscore(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("b", 1, 5.0), ("b", 2, 5.0), ("b", 3, None)], "g string, i int, x double")
    got = rows(stats.winsor_zscore(df, "x", ["g"], "z"), "g", "i", "z")
    close(got[:3], [("a", 1, -1.2247448714), ("a", 2, 0.0), ("a", 3, 1.2247448714)])
    assert got[3:] == [("b", 1, 0.0), ("b", 2, 0.0), ("b", 3, None)]


def test_composite_counts_only_active_factors(spark):
    df = spark.createDataFrame([("A", 1.0, 1.0), ("B", 0.5, -1.0), ("C", 1.0, None), ("D", None, None)], "symbol string, z_a double, z_b double").withColumns({"session": F.lit(1), "z_c": F.lit(None).cast("double")})
    got = rows(factors.composite(df, {"a": 0.20, "b": -0.18, "c": 0.5}, ["session"]), "symbol", "score")
    close(got, [("A", 100 / 3), ("B", 100.0), ("C", 200 / 3), ("D", 0.0)])


def test_ranks(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 2.0), ("m", 2.0), ("m", 4.0), ("one", 7.0), ("flat", 3.0), ("flat", 3.0), ("flat", None)], "g string, x double")
    d = df.select("g", "x", stats.scaled_rank("x", ["g"]).alias("s"), stats.average_rank("x", ["g"]).alias("r")).collect()
    assert {(r["g"], r["x"], r["s"], r["r"]) for r in d} == {("m", 1.0, 0.0, 1.0), ("m", 2.0, 50.0, 2.5), ("m", 4.0, 100.0, 4.0), ("one", 7.0, 50.0, 1.0), ("flat", 3.0, 50.0, 1.5), ("flat", None, None, None)}


def test_sentiment_labels(spark):
    values = [29.999, 30.0, 45.0, 60.0, 75.0, 75.001]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", market.sentiment_label(F.col("x")).alias("l"))
    assert [x[1] for x in rows(df, "x", "l")] == ["coldest", "weak", "neutral", "strong", "strong", "hottest"]


def test_trade_costs_and_limits(spark):
    df = spark.createDataFrame([(10000.0, False), (10000.0, True), (0.0, True)], "a double, s boolean").select(market.trade_cost(F.col("a"), F.col("s")).alias("c"))
    close(rows(df, "c"), [(0.0,), (10.2,), (20.2,)])
    lim = spark.createDataFrame([(10.055,)], "p double").select(clean.limit_price(F.col("p"), F.lit(0.1), True).alias("u"), clean.limit_price(F.lit(0.25), F.lit(0.1), True).alias("v"))
    assert rows(lim, "u", "v") == [(11.06, 0.28)]
    st = spark.createDataFrame([("MAIN", None), ("MAIN", False), ("BSE", False), ("STAR", True)], "b string, s boolean").select("b", clean.limit_ratio(F.col("b"), F.col("s")).alias("r"))
    assert sorted(x["r"] for x in st.collect()) == [0.05, 0.05, 0.10, 0.30]


def test_rank_ic_and_summary(spark):
    df = spark.createDataFrame(
        [("up", i, float(i), float(i)) for i in range(3)] + [("down", i, float(i), float(-i)) for i in range(3)] + [("flat", i, 1.0, float(i)) for i in range(3)] + [("one", 1, 1.0, 1.0)], "d string, i int, s double, f double"
    )
    got = dict(rows(metrics.rank_ic(df, "s", "f", ["d"]), "d", "ic"))
    assert math.isclose(got["up"], 1.0) and math.isclose(got["down"], -1.0) and got["flat"] is None and got["one"] is None
    ic = spark.createDataFrame([("x", 0.1), ("x", 0.2), ("x", 0.3), ("x", None)], "g string, ic double")
    close(rows(metrics.ic_summary(ic, ["g"]), "n", "mean", "std", "ir", "t"), [(3, 0.2, 0.1, 2.0, 3.4641016)])


def test_turnover_calibration_performance(spark):
    t = spark.createDataFrame([("g", None), ("g", 0.5), ("g", None), ("g", 1.0)], "g string, t double")
    close(rows(metrics.turnover_stats(t, "t", ["g"]), "n", "total", "mean", "annual"), [(2, 1.5, 0.75, 94.5)])
    p = spark.createDataFrame([(0.0, 0), (0.2, 0), (0.8, 1), (1.0, 1)], "p double, h int")
    got = rows(metrics.calibration(p, "p", "h", 5), "bin", "n", "brier")
    close(got, [(0, 1, 0.02), (1, 1, 0.02), (2, 0, 0.02), (3, 0, 0.02), (4, 2, 0.02)])
    nav = spark.createDataFrame([("a", D(2024, 1, i + 1), v) for i, v in enumerate([1.0, 1.1, 1.0, 1.2])] + [("bad", D(2024, 1, 1), 0.0)], "r string, session date, nav double")
    close(rows(metrics.nav_performance(nav, ["r"]), "r", "n", "total", "drawdown"), [("a", 4, 0.2, 1 / 1.1 - 1)])


def test_layers_use_positions(spark):
    df = spark.createDataFrame([("d", f"{i:03d}", float(i), float(i)) for i in range(100)] + [("solo", "x", 1.0, 5.0)], "session string, symbol string, s double, f double")
    got = rows(metrics.layers(df, "s", "f", ["session"]), "session", "layer", "n", "ret")
    assert got[-1] == ("solo", 9, 1, 5.0)
    counts = [n for s, _, n, _ in got if s == "d"]
    assert counts == [sum(min(9, i * 10 // 99) == k for i in range(100)) for k in range(10)]


def test_future_rows_change_nothing(spark):
    facts = [("s", "2024Q1", "roe", 1.0, D(2024, 5, 1)), ("s", "2024Q2", "roe", None, D(2024, 8, 1)), ("s", "2023Q4", "roe", 0.5, D(2024, 2, 1))]
    schema = "symbol string, period string, metric string, value double, available date"
    at = F.lit("2024-08-15").cast("date")
    base = rows(pit.latest_period(spark.createDataFrame(facts, schema), at), "symbol", "period", "value")
    later = spark.createDataFrame(facts + [("s", "2024Q3", "roe", 9.0, D(2024, 11, 1))], schema)
    assert base == rows(pit.latest_period(later, at), "symbol", "period", "value") == [("s", "2024Q1", 1.0)]


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([("a", D(2024, 1, d)) for d in (1, 5, 9)] + [("b", D(2024, 1, 5))], "symbol string, session date")
    events = spark.createDataFrame([("a", D(2024, 1, 5), 1.1), ("a", D(2024, 1, 7), 1.2)], "symbol string, since date, f double")
    assert rows(pit.asof_backward(left, events, ["symbol"], "session", "since", "f"), "symbol", "session", "f") == [("a", D(2024, 1, 1), None), ("a", D(2024, 1, 5), 1.1), ("a", D(2024, 1, 9), 1.2), ("b", D(2024, 1, 5), None)]
    t = lambda s: dt.datetime(2024, 1, 1, 10, 0, s)
    l2 = spark.createDataFrame([(1, "k", t(0)), (2, "k", t(30)), (3, "z", t(0))], "id int, key string, ts timestamp")
    r2 = spark.createDataFrame([("k", t(4), "x"), ("k", t(26), "y"), ("k", t(34), "w")], "key string, ts timestamp, v string")
    assert rows(pit.nearest(l2, r2, ["key"], "ts", 10), "id", "v_near") == [(1, "x"), (2, "y"), (3, None)]


def test_gap_rules(spark):
    bar = [("a", D(2024, 1, d), 10.0 + d, 1.0, 5.0) for d in (1, 2, 4)] + [("b", D(2024, 1, d), 20.0, 1.0, 5.0) for d in (1, 2, 3, 4)]
    bars = spark.createDataFrame([(s, d, c, c, c, c, v, x) for s, d, c, v, x in bar], "symbol string, session date, open double, high double, low double, close double, volume double, amount double")
    adj = spark.createDataFrame([("a", D(2024, 1, 1), 2.0)], "symbol string, session date, adj_factor double")
    a = {(r["symbol"], r["session"].day): (r["px"], r["degraded"]) for r in factors.adjusted(bars, adj).collect()}
    assert a["a", 1] == (22.0, False) and a["a", 2] == (12.0, True)
    got = {(r["symbol"], r["session"].day): r for r in factors.price_factors(bars, adj, 1, 2).collect()}
    assert len(got) == 8 and math.isclose(got["a", 4]["momentum_short"], 14 / 12 - 1) and got["a", 3]["momentum_short"] == 0 and got["a", 1]["momentum_short"] is None


def test_life_cycle_rules(spark):
    cases = [("boom", 81.0, 1.0, 71.0, 1.0), ("rising", 70.0, 1.0, 60.0, None), ("decline", 50.0, -1.0, 50.0, 1.0), ("bottoming", 20.0, 0.0, 40.0, None), ("recovery", 50.0, 1.0, 40.0, 1.0), (None, 50.0, 1.0, 40.0, None), (None, 70.0, 0.0, 80.0, 1.0)]
    df = spark.createDataFrame([(i, *c[1:]) for i, c in enumerate(cases)], "i int, s double, t double, r double, f double")
    stage = sectors.life_cycle(*(F.col(c) for c in "strf"))
    assert [x[1] for x in rows(df.select("i", stage.alias("stage")), "i", "stage")] == [c[0] for c in cases]


def test_sector_gate_and_future_rows(spark):
    days = [D(2024, 1, i + 1) for i in range(31)]
    ret = [(s, d, None if d == days[0] else ((ord(s) * 7 + d.day * 13) % 11 - 5) / 100.0, 1.0) for s in "abcdef" for d in days if (s, d) != ("f", days[9])]
    r = spark.createDataFrame(ret, "symbol string, session date, ret double, amount double")
    p = spark.createDataFrame([("P", "a"), ("P", "b"), ("Q", "c"), ("Q", "d"), ("R", "e"), ("R", "f"), ("S", "a")], "plate string, symbol string")
    got = sectors.panel(r, p)
    assert [x[0] for x in rows(got.select("plate").distinct(), "plate")] == ["P", "Q"]  # R misses a member once, S has one member
    assert got.count() == 2 * 30 and got.where("coverage < 1").count() == 0
    flow = got.select("plate", "session", F.col("mean_ret").alias("flow"))
    scored = lambda panel: sectors.scores(sectors.features(sectors.with_flows(panel, flow)), 20, 84)
    early = rows(scored(got.where("session <= '2024-01-28'")), "plate", "session", "score", "stage")
    assert early == [x for x in rows(scored(got), "plate", "session", "score", "stage") if x[1] <= D(2024, 1, 28)]
    assert any(x[2] is not None for x in early) and scored(got).where("reversal is not null").count() == 0
    with pytest.raises(PySparkException, match="too few sessions"):
        sectors.validation(scored(got), 5).collect()
    with pytest.raises(PySparkException, match="two flows"):
        sectors.with_flows(got, flow.union(flow)).collect()


def test_sentiment_looks_only_back(spark):
    n = 40
    day = [D(2024, 1, 1) + dt.timedelta(i) for i in range(n)]
    rng = random.Random(3)
    obs = [(day[i], rng.randrange(50), rng.randrange(50), rng.randrange(9), rng.randrange(9), float(rng.randrange(1, 100))) for i in range(n)]
    index = [(d, 100.0 + rng.random()) for d in day if d.day % 9]
    schema = "ts date, advancers int, decliners int, limit_up_n int, broken int, amount double"

    def run(k):
        o = market.observations(spark.createDataFrame(obs[:k], schema))
        i = spark.createDataFrame([x for x in index if x[0] <= day[k - 1]], "ts date, close double")
        return rows(market.sentiment(o, i, 10), "ts", "sentiment", "label", "degraded")

    assert run(n)[:25] == run(25)
    first = run(1)[0]
    assert first[1:] == (50.0, "neutral", "share,volume,ecology,volatility")
    ranked = rows(market.trailing_rank(spark.createDataFrame([(day[i], v) for i, v in enumerate([1.0, 2.0, None, 2.0, 4.0, 0.0])], "ts date, v double"), "v", "r", 4), "ts", "r", "r_n")
    close([x[1:] for x in ranked], [(50.0, 1), (100.0, 2), (None, 2), (75.0, 3), (100.0, 4), (0.0, 4)])


def test_feed_events(spark):
    d = [D(2024, 1, i) for i in range(1, 6)]
    obs = spark.createDataFrame([(d[0], 5, 3, 0, 0, 100.0, "weak"), (d[1], 3, 3, 0, 0, 104.0, "weak"), (d[2], 2, 3, 7, 3, 105.0, "weak"), (d[3], 4, 3, 6, 4, 105.0, "neutral"), (d[4], 5, 3, 1, 4, 90.0, "neutral")],
                                "ts date, advancers int, decliners int, limit_up_n int, broken int, amount double, label string")
    got = rows(market.changes(market.observations(obs)), "ts", "kind")
    # 30 % is no crossing and leaving a tie no flip
    assert got == [(d[2], "limit_up"), (d[3], "breadth"), (d[3], "broken"), (d[3], "label"), (d[4], "amount"), (d[4], "limit_up")]


def test_volatility_groups_and_plates(spark):
    out = spark.createDataFrame([(s, 1) for s in "abcdx"] + [("a", 2)], "symbol string, session int")
    vol = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("c", 1, 3.0), ("d", 1, 4.0), ("a", 2, 1.0), ("b", 2, 1.0), ("c", 2, 2.0)], "symbol string, session int, z double")
    assert rows(market.volatility_groups(out, vol), "session", "symbol", "tercile") == [(1, "a", "low"), (1, "b", "low"), (1, "c", "mid"), (1, "d", "high"), (1, "x", "unavailable"), (2, "a", "insufficient")]
    plates = spark.createDataFrame([("P", "a"), ("P", "b"), ("Q", "b")], "plate string, symbol string")
    assert rows(market.single_plate(out.where("session = 1 and symbol < 'd'"), plates), "symbol", "plate") == [("a", "P"), ("b", "unknown"), ("c", "unknown")]


def test_exact_days_needs_all_from_one_source(spark):
    days = [D(2024, 1, i) for i in range(1, 8)]
    r = [("ok", d, 1.0, "x") for d in days] + [("gap", d, 1.0, "x") for d in days[:-1]] + [("mix", d, 1.0, "x" if d.day % 2 else "y") for d in days]
    assert rows(sectors.exact_days(spark.createDataFrame(r, "plate string, session date, flow double, source string")), "plate", "flow") == [("ok", 5.0)]


def test_merges_are_idempotent(spark):
    schema = "k int, v double, source string, available date"
    t = spark.createDataFrame([(1, 1.0, "mock", D(2024, 1, 2)), (2, 2.0, "exchange", D(2024, 1, 2))], schema)
    n = spark.createDataFrame([(1, 9.0, "exchange", D(2024, 1, 3)), (2, 9.0, "vendor_a", D(2024, 1, 1)), (3, 9.0, "exchange", D(2024, 1, 3))], schema)
    repaired = merge.insert_or_repair(t, n, ["k"])
    assert rows(repaired, "k", "v") == [(1, 9.0), (2, 2.0), (3, 9.0)] == rows(merge.insert_or_repair(repaired, n, ["k"]), "k", "v")
    assert rows(merge.insert_absent(t, n.union(n), ["k"]), "k", "v") == [(1, 1.0), (2, 2.0), (3, 9.0)]
    assert rows(merge.keep_earliest(t, n, ["k"], "available"), "k", "v", "available") == [(1, 9.0, D(2024, 1, 2)), (2, 9.0, D(2024, 1, 1)), (3, 9.0, D(2024, 1, 3))]
    same = n.withColumn("v", F.lit(2.0))
    assert rows(merge.upsert_changed(t, same, ["k"], "v"), "k", "source") == [(1, "exchange"), (2, "exchange"), (3, "exchange")]


def test_replace_partition(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "day int, v string")
    merge.replace_partition(a, str(tmp_path / "t"), "day")
    merge.replace_partition(spark.createDataFrame([(2, "z")], "day int, v string"), str(tmp_path / "t"), "day")
    assert rows(spark.read.parquet(str(tmp_path / "t")), "day", "v") == [(1, "x"), (2, "z")]


def test_strict_scan_raises(spark):
    good = spark.createDataFrame([("exchange", 1)], "source string, v int")
    assert scan.strict(good).count() == 1
    with pytest.raises(PySparkException, match="not audited"):
        scan.strict(good.union(spark.createDataFrame([("mock", 2)], "source string, v int"))).collect()


def test_synthetic_source(spark):
    from tidemark.sources.synthetic import SyntheticBars

    spark.dataSource.register(SyntheticBars)
    read = lambda start: spark.read.format("synthetic_bars").option("symbols", "000001,600000").option("start", start).option("end", "2024-02-29").load()
    whole, part = read("2024-01-01"), read("2024-02-01")
    assert part.count() == 42 and rows(part, "symbol", "session", "close") == rows(whole.where("session >= '2024-02-01'"), "symbol", "session", "close")
    assert scan.failover([whole.where("symbol = 'none'"), whole], ["symbol", "session"]).where("provider <> 1").count() == 0


def test_text(spark):
    u = spark.createDataFrame([("HTTPS://A.com//x//y?utm_source=1&b=2&a=1#f",), ("http://b.org/p",)], "u string")
    assert rows(u.select(text.canonical_url(F.col("u")).alias("c")), "c") == [("http://b.org/p",), ("https://a.com/x/y?a=1&b=2",)]
    n = spark.createDataFrame([("ａ  b\n c", None)], "t string, z string").select(text.normalise(F.col("t"), True).alias("n"), text.normalise(F.col("z"), True).alias("z"))
    assert rows(n, "n", "z") == [("a b c", None)]
    long = "One sentence. " * 30
    parts = spark.createDataFrame([(long,), ("",), ("x" * 500,)], "t string").select("t", text.segments(F.col("t"), 80).alias("p")).collect()
    for r in parts:
        assert "".join(r["t"][s:e] for s, e in r["p"]) == r["t"] and all(0 < e - s <= 80 for s, e in r["p"])
    news = spark.createDataFrame([(1, "u1", "h1"), (2, "u1", "h2"), (3, "u3", "h1"), (4, "u4", "h4")], "id int, url string, content_hash string")
    assert [r[0] for r in rows(text.dedupe_news(news, ["id"]), "id")] == [1, 4]


def test_backtest_three_days(spark):
    d = [D(2024, 1, i) for i in (1, 2, 3)]
    targets = spark.createDataFrame([("r", d[1], "A")], "run string, session date, symbol string")
    px = spark.createDataFrame([(d[0], "A", 10.0, 10.0, True, True), (d[1], "A", 10.0, 11.0, True, True), (d[2], "A", 11.0, 12.0, True, True), (d[1], "B", 1.0, 1.0, True, True)], "session date, symbol string, open_px double, close_px double, buy_ok boolean, sell_ok boolean")
    got = sorted(backtest.backtest(targets, px, 100_000.0).collect(), key=lambda r: r["session"])
    assert [r["holdings"] for r in got] == [0, 1, 1] and got[0]["turnover"] is None
    shares = (100_000 - got[1]["cash"]) / (10 * (1 + backtest.COMMISSION + backtest.TRANSFER + backtest.SLIPPAGE))
    assert got[1]["cash"] >= -1e-6 and math.isclose(got[2]["nav"], got[2]["cash"] + shares * 12, rel_tol=1e-9) and got[1]["turnover"] > 0.99


def test_replay_of_whole_prices_agrees(spark):
    """The backtest over held rows against a replay that sees every price row of every symbol."""
    import pandas as pd

    rng = random.Random(8)
    days = [D(2024, 1, 1) + dt.timedelta(i) for i in range(30)]
    px = [(d, f"s{i:02d}", 10 + 5 * rng.random(), 10 + 5 * rng.random(), rng.random() < 0.8, rng.random() < 0.7) for d in days for i in range(12) if rng.random() < 0.9]
    targets = [(r, d, f"s{i:02d}") for r, n in (("x", 1), ("y", 4)) for d in days[2::n] for i in rng.sample(range(12), 3)]
    t = spark.createDataFrame(targets, "run string, session date, symbol string")
    p = spark.createDataFrame(px, "session date, symbol string, open_px double, close_px double, buy_ok boolean, sell_ok boolean")
    got = {(r["run"], r["session"]): r for r in backtest.backtest(t, p, 1e5).collect()}
    whole = pd.DataFrame(px, columns=["session", "symbol", "open_px", "close_px", "buy_ok", "sell_ok"])
    for run in "xy":
        want = backtest.replay(run, pd.DataFrame([x for x in targets if x[0] == run], columns=["run", "session", "symbol"]), whole, 1e5)
        assert len(want) == 30
        for w in want.itertuples():
            g = got[run, w.session]
            assert math.isclose(g["nav"], w.nav, rel_tol=1e-9) and (g["holdings"], g["stale"]) == (w.holdings, w.stale)
    held = backtest.held_prices(t, p)
    assert held.count() < p.count() * 2 and held.where("run = 'y'").count() < p.count() * 0.7
    w = metrics.effective_window(spark.createDataFrame([("a", 1, None), ("a", 2, 0.0), ("a", 3, 0.4), ("a", 4, 0.1), ("b", 1, None), ("b", 2, 0.0)], "run string, session int, turnover double"))
    assert rows(w, "run", "session") == [("a", 2), ("a", 3), ("a", 4), ("b", 1), ("b", 2)]


def test_sink_survives_a_replayed_batch(spark, tmp_path):
    import glob
    import os

    schema = "k string, v long, ts timestamp"
    for i, k in enumerate("abcdea"):
        spark.createDataFrame([(k, i, dt.datetime(2024, 1, 1, 0, 0, i))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    base = f"file://{tmp_path}/a"
    jobs.run(source(), base, "append", ["k"])
    want = rows(jobs.written(spark, source().schema, base, "append", ["k"]), "k", "v")
    assert len(want) == 5
    commits = sorted((int(os.path.basename(p)), p) for p in glob.glob(f"{tmp_path}/a/checkpoint/commits/[0-9]*"))
    assert len(commits) == 6
    os.remove(commits[-1][1])
    os.remove(f"{tmp_path}/a/checkpoint/commits/.{commits[-1][0]}.crc")
    jobs.run(source(), base, "append", ["k"])
    assert rows(jobs.written(spark, source().schema, base, "append", ["k"]), "k", "v") == want
    totals = jobs.drain(jobs.minute_breadth(source().select("ts", F.lit("e").alias("event_type"), F.col("v").cast("double").alias("value")), "10 minutes"), "update", ["minute", "event_type"])
    assert rows(totals, "n", "total") == [(6, 15.0)]


def test_style_guardrails_health(spark):
    schema = "i int, mode string, side string, confidence double, notional double, equity double, cash double, position double, sector double, day_pnl double, open_orders int, age int"
    cases = [
        (0, "CONFIRM_TO_TRADE", "BUY", 0.68, 5.0, 100.0, 5.0, 0.05, 0.25, -0.0199, 0, 120),
        (1, "PAPER_AUTO", "SELL", 0.7, 10.0, 100.0, 0.0, 0.1, 0.0, 0.0, 0, -5),
        (2, "PAPER_AUTO", "BUY", 0.7, 1.0, 100.0, 5.0, 0.0, 0.0, -0.02, 0, 0),  # a loss of exactly the limit refuses
        (3, "RESEARCH", "SELL", 0.5, 11.0, 100.0, 5.0, 0.1, 0.2, 0.0, 1, -6),
        (4, "LIMITED_LIVE_AUTO", "BUY", 0.7, 10.0, 100.0, 9.0, 0.1, 0.25, 0.0, 0, 121),
        (5, None, "BUY", None, None, 100.0, 9.0, None, None, None, None, None),
    ]
    g = market.guardrails(spark.createDataFrame(cases, schema))
    assert rows(g, "i", "approved", "reasons") == [
        (0, True, ""), (1, True, ""), (2, False, "daily_loss"), (3, False, "confidence,future_data,mode,open_order,oversell,sector_exposure"),
        (4, False, "cash,live_disabled,sector_exposure,single_position,stale_data"),
        (5, False, "cash,confidence,daily_loss,future_data,mode,open_order,sector_exposure,single_position,stale_data"),
    ]
    assert market.guardrails(spark.createDataFrame(cases[1:2], schema), gateway=False).first()["reasons"] == "gateway_disabled"
    assert [r["confirm"] for r in sorted(g.collect())] == [True, False, False, False, True, False]
    a, b = (spark.createDataFrame([(i,) for i in x], "k int") for x in ((1, 2), (2, 3)))
    assert rows(health.orphans(a, b, ["k"]), "k", "side") == [(1, "left"), (3, "right")]
    many = health.fingerprint(spark.range(200_000), ["id"]).first()
    assert many["n"] == 200_000 and 0 <= many["digest"] < 2**60 and health.fingerprint(a.limit(0), ["k"]).first()["digest"] == 0
    assert health.fingerprint(a, ["k"]).first() == health.fingerprint(a.orderBy(F.desc("k")), ["k"]).first() != health.fingerprint(b, ["k"]).first()


def test_slot_matching_is_one_to_one(spark):
    s = spark.createDataFrame([("j", 0), ("j", 100), ("j", 200)], "job string, at long")
    r = spark.createDataFrame([("j", 95), ("j", 104), ("j", 500)], "job string, at long")
    assert rows(jobs.slot_matches(s, r, 100), "slot", "run") == [(0, 95), (100, 104), (200, None)]


def test_slots_apart_are_not_one_group(spark):
    rng = random.Random(4)
    for step, tolerance, largest in ((1000, 100, 1), (100, 60, 40)):
        s = [(j, step * i) for j in "ab" for i in range(40)]
        r = [(rng.choice("aab"), rng.randrange(-200, step * 40 + 200)) for _ in range(400)] + [("a", step), ("a", step), ("c", 5)]
        pairs = sorted((abs(x - y), x, y, i, k, j) for i, (j, x) in enumerate(s) for k, (q, y) in enumerate(r) if j == q and abs(x - y) <= tolerance)
        found, used = {}, set()
        for _, _, y, i, k, _ in pairs:
            if i not in found and k not in used:
                found[i] = y
                used.add(k)
        slots, runs = spark.createDataFrame(s, "job string, at long"), spark.createDataFrame(r, "job string, at long")
        want = sorted((j, x, found.get(i, -1)) for i, (j, x) in enumerate(s))
        assert rows(jobs.slot_matches(slots, runs, tolerance).fillna(-1), "job", "slot", "run") == want
        assert jobs.slot_clusters(slots, runs, tolerance)[0].groupBy("job", "cluster").count().agg(F.max("count")).first()[0] == largest


def test_nearest_makes_no_pairs(spark):
    """Keys that are null match nothing, equal distances go to the earlier row, and no join pairs the rows of a bucket."""
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rng = random.Random(4)
    left = [(i, rng.choice(["a", "b", None]), None if i == 7 else at(rng.randrange(4000))) for i in range(300)]
    right = [(k, at(s), s) for k in ("a", "b", None) for s in rng.sample(range(4000), 25)] + [("a", None, 1)]
    got = pit.nearest(spark.createDataFrame(left, "id int, k string, ts timestamp"), spark.createDataFrame(right, "k string, ts timestamp, v int"), ["k"], "ts", 60)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    own = {r["id"]: r["v_near"] for r in got.collect()}
    for i, k, t in left:
        near = [(abs((u - t).total_seconds()), u, v) for q, u, v in right if t and u and k and q == k and abs((u - t).total_seconds()) <= 60]
        assert own[i] == (min(near)[2] if near else None)
