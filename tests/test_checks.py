"""Hand-worked cases of provenance, integrity rules, verdicts and feeds."""

import datetime as dt

from pyspark.sql import functions as F
from tidemark.operators import checks as op
from tidemark.operators import signals

T = lambda h, m=0, s=0.0, d=15: dt.datetime(2024, 1, d, h, m, int(s), int(round(s % 1 * 1e6)))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_anomalies(spark):
    q = spark.createDataFrame([("a", 7.0, None), ("b", -6.9, 10.0), ("c", 6.9, 9.9), ("d", -20.0, 30.0), ("e", None, 12.0), ("f", 9.0, 1.0)], "symbol string, change double, turnover double")
    watch = spark.createDataFrame([(s,) for s in "abcdea"], "symbol string")
    got = {r["symbol"]: (r["direction"] and round(r["direction"], 9), round(r["strength"], 9), r["reasons"]) for r in op.capital_anomalies(q, watch).collect()}
    assert got == {"a": (0.7, 0.7, "price"), "b": (-0.69, 0.69, "turnover"), "d": (-1.0, 1.0, "price+turnover"), "e": (None, 0.6, "turnover")}


def test_provenance_takes_the_nearest_within_five_seconds(spark):
    alerts = spark.createDataFrame([(1, "a", T(0), "m", T(9)), (2, "a", T(0), "m", T(9, 1)), (3, "a", None, "m", T(9)), (4, "a", T(0), "", T(9)), (5, "b", T(0), "m", T(9))], "id int, symbol string, as_of timestamp_ntz, model string, created timestamp_ntz")
    fc = [(10, "a", T(0), "m", T(9, 0, 5), "mock"), (11, "a", T(0), "m", T(8, 59, 56), "exchange"), (12, "a", T(0), "m", T(9, 1, 5.000001), "exchange"), (13, "b", T(0), "n", T(9), "exchange"), (14, "a", T(0), "", T(9), "exchange")]
    f = spark.createDataFrame(fc, "id int, symbol string, as_of timestamp_ntz, model string, created timestamp_ntz, provider string")
    assert rows(op.provenance(alerts, f, signals.provider_audited)) == [(1, 11, "exchange", True), (2, None, None, False), (3, None, None, False), (4, None, None, False), (5, None, None, False)]
    assert op.provenance(alerts.limit(0), f, signals.provider_audited).count() == 0


def test_signal_origin(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (10, 11, 12, 15)], "session date")
    # local time is eight hours ahead: 07:06 is 15:06
    cases = [(1, T(1, d=11), None, "ok", 11), (2, T(1, d=13), None, "invalid", None), (3, T(1, d=16), None, "pending", None), (4, None, T(7, 6, d=12), "ok", 12), (5, None, T(7, 5, d=12), "ok", 11), (6, None, T(1, d=14), "ok", 12), (7, None, T(7, d=10), "pending", None), (8, None, T(9, d=30), "ok", 15)]
    s = spark.createDataFrame([(i, a, c) for i, a, c, _, _ in cases], "id int, as_of timestamp_ntz, created timestamp_ntz")
    got = {r["id"]: (r["status"], r["origin"] and r["origin"].day) for r in op.signal_origin(s, days).collect()}
    assert got == {i: (st, d) for i, _, _, st, d in cases}
    assert {r["status"] for r in op.signal_origin(s, days.limit(0)).collect()} == {"pending"}


def test_faults(spark):
    good = dict(symbol="1", side="BUY", confidence=0.5, model="m", notional=105.0, alert_symbol="SZ.1", action="ADD", expires=T(9), verified=True, alert_confidence=0.5, alert_model="m", suggested=100.0, low=1.0, high=2.0)
    cases = [({}, None), ({"symbol": "2"}, "symbol"), ({"action": "HOLD"}, "action"), ({"side": "SELL"}, "side"), ({"expires": T(8)}, "expired"), ({"expires": None}, "expired"), ({"verified": False}, "provider"), ({"alert_confidence": 0.6}, "confidence"), ({"alert_model": ""}, "model")]
    cases += [({"suggested": None}, "suggested"), ({"suggested": -100.0}, "direction"), ({"high": 1.0}, "target"), ({"low": float("nan")}, "target"), ({"notional": 105.1}, "notional")]
    schema = "symbol string, side string, confidence double, model string, notional double, alert_symbol string, action string, expires timestamp_ntz, verified boolean, alert_confidence double, alert_model string, suggested double, low double, high double"
    d = spark.createDataFrame([tuple((good | c).values()) for c, _ in cases], schema)
    assert [r[0] for r in d.select(op.alert_fault(F.lit(T(8)))).collect()] == [w for _, w in cases]
    snap = [(100.0, 40.0, 60.0, 60.0, None), (100.0, 40.0, 61.0, 60.0, None), (100.0, 40.0, 61.1, 61.1, "account"), (100.0, 101.0, 0.0, 0.0, "cash"), (100.0, 40.0, 60.0, 62.0, "positions"), (None, 1.0, 1.0, 1.0, "numbers"), (1e5, 0.0, 1e5 + 99, 1e5, None)]
    d = spark.createDataFrame(snap, "total double, cash double, market double, positions double, want string")
    assert d.where(~op.reconciliation_fault().eqNullSafe(F.col("want"))).count() == 0
    bars = [(2.0, 3.0, 1.0, 2.0, 1.0, True), (2.0, 1.9, 1.0, 1.5, 1.0, False), (2.0, 3.0, 2.1, 2.5, 1.0, False), (2.0, 3.0, 1.0, 2.0, -1.0, False), (None, 3.0, 1.0, 2.0, 1.0, False), (2.0, 3.0, 0.0, 2.0, 1.0, False), (2.0, 3.0, 1.0, 2.0, None, False)]
    d = spark.createDataFrame(bars, "open double, high double, low double, close double, volume double, want boolean").withColumn("amount", F.lit(0.0))
    assert d.where(op.bar_consistent() != F.col("want")).count() == 0


def test_flows_and_rates(spark):
    f = [("a", T(9), "1", None, 2.0, 3.0), ("a", T(10), "2", None, 2.0, None), ("a", T(11), "nan", 1.0, 1.0, 1.0), ("a", T(9, d=16), "4", 7.0, 1.0, 1.0), ("a", None, "4", 7.0, 1.0, 1.0)]
    d = spark.createDataFrame(f, "symbol string, at timestamp_ntz, net string, main double, super double, big double")
    assert rows(op.daily_flows(d)) == [("a", dt.date(2024, 1, 15), 2.0, None), ("a", dt.date(2024, 1, 16), 4.0, 7.0)]
    day = dt.date(2024, 1, 15)
    s = [(1, day, T(9), 5, 0.4), (1, day, T(12), 5, 0.9), (1, dt.date(2024, 1, 14), T(10), 5, 0.1), (2, day, T(9), 0, 0.4), (3, day, T(9), 5, 1.4), (4, dt.date(2024, 1, 16), T(9), 5, 0.4)]
    d = spark.createDataFrame(s, "decile int, as_of date, updated timestamp_ntz, samples int, win_rate double")
    assert rows(op.visible_rates(d, F.lit(day), F.lit(T(11)))) == [(1, 0.4)]


def test_verdicts(spark):
    cases = [(0.1, 1.96, 0.2, 0.1, 0.1, 0.1, 0, "failed"), (0.1, 2.0, 0.2, 0.1, 0.3, 0.1, 1, "partial"), (0.1, 2.0, 0.2, 0.1, 0.1, None, 1, "improved"), (None, None, None, 0.1, 0.1, 0.1, 4, "failed"), (-0.1, -3.0, 0.2, 0.1, 0.1, 0.1, 1, "failed")]
    d = spark.createDataFrame(cases, "ic double, t double, total double, benchmark double, market double, spread double, n int, want string")
    assert d.where((F.size(op.failed_gates()) != F.col("n")) | (op.verdict() != F.col("want"))).count() == 0


def test_gross_nav(spark):
    day = lambda n: dt.date(2024, 1, n)
    d = spark.createDataFrame([("a", day(2), 0.5), ("a", day(3), None), ("a", day(4), -0.5), ("b", day(2), -1.0), ("b", day(3), 0.1)], "book string, session date, spread double")
    got = rows(op.gross_nav(d, ["book"]))
    assert [(r[1].day, round(r[2], 9)) for r in got] == [(1, 1.0), (2, 1.5), (4, 0.75)] and {r[0] for r in got} == {"a"}


def test_screens_and_feeds(spark):
    f = spark.createDataFrame([("a", 1, 5, 0.1), ("a", 2, 20, 0.2), ("b", 1, 5, float("nan")), ("c", 1, 5, 0.3), ("c", 2, 5, 0.4)], "symbol string, as_of int, horizon int, expected double")
    assert rows(op.latest_expected(f, 5)) == [("c", 0.4)]
    c = spark.createDataFrame([("x", None, 9.0, 1), ("y", 0.1, 1.0, 1), ("z", 0.1, 2.0, 1)], "symbol string, expected double, score double, run int")
    assert {r["symbol"]: r["rank"] for r in op.expected_rank(c, ["run"]).collect()} == {"z": 1, "y": 2, "x": 3}
    e = [(1, "a", "x", -0.5, T(9, d=12), T(9)), (2, "a", "x", -0.6, T(8, 59, d=12), T(9)), (3, "a", "thesis_shift", -1.0, T(8), T(8)), (4, "a", "x", -0.4, T(8), T(8)), (5, "a", "x", -0.9, T(8), T(9, 1)), (6, "b", "x", -0.9, T(9, 1), T(8))]
    d = spark.createDataFrame(e, "id int, symbol string, event_type string, direction double, occurred timestamp_ntz, ingested timestamp_ntz")
    assert rows(op.recent_negative(d, F.lit(T(9)))) == [("a", 1)]
    assert [r["id"] for r in op.timeline(d, 2).where(F.col("day") == dt.date(2024, 1, 15)).orderBy("rank").collect()] == [6, 5]


def test_evidence_and_codes(spark):
    d = spark.createDataFrame([("a b", "x a b", True, True), ("a  b", "xa　b", False, True), (" \n", "x \n", False, False), (None, "x", False, False), ("a", None, False, False)], "span string, text string, exact boolean, loose boolean")
    for k in ("exact", "loose"):
        assert d.where(op.evidence_matches(F.col("span"), F.col("text"), k == "exact") != F.col(k)).count() == 0
    t = spark.createDataFrame([(1, "000001 0000023 x000003", "000009"), (2, "", None), (3, None, None)], "id int, text string, ingested string")
    u = spark.createDataFrame([("000001",), ("000003",), ("000002",)], "symbol string")
    assert rows(op.allowed_symbols(t, u)) == [(1, ["000001", "000003", "000009"]), (2, []), (3, [])]
    n = spark.createDataFrame([([" b", "a", "b ", " "],), ([],), (None,)], "n array<string>")
    assert [r[0] for r in n.select(op.canonical_names(F.col("n"))).collect()] == [["a", "b"], [], None]
