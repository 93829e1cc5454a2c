"""Bars read through, extracted events, pages, quotes and the availability audit on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from tidemark.operators import bars, extract, markup, release
from tidemark.sources import quotes

D = dt.date
BARS = "symbol string, session date, open double, high double, low double, close double, volume double, amount double"


def bar(s, d, x, **k):
    return s, d, x, x + 1, x - 1, k.get("close", x + 0.5), 10.0, 100.0


# ---------------------------------------------------------------- X21


def test_weeks_end_on_friday_and_skip_incomplete_days(spark):
    days = [D(2024, 1, d) for d in (4, 5, 6, 7, 8, 12, 13)]  # Thursday, Friday, Saturday, Sunday, Monday, Friday, Saturday
    rows = [bar("a", d, float(i)) for i, d in enumerate(days)] + [("a", D(2024, 1, 9), 1.0, None, 1.0, 1.0, 5.0, 5.0)]
    got = sorted(tuple(r) for r in bars.resampled(spark.createDataFrame(rows, BARS), "w").collect())
    assert got == [
        ("a", D(2024, 1, 5), 0.0, 2.0, -1.0, 1.5, 20.0, 200.0), ("a", D(2024, 1, 12), 2.0, 6.0, 1.0, 5.5, 40.0, 400.0), ("a", D(2024, 1, 13), 6.0, 7.0, 5.0, 6.5, 10.0, 100.0),
    ]
    with pytest.raises(ValueError):
        bars.period(F.col("session"), "y")


def test_a_symbol_comes_from_one_place(spark):
    provider = spark.createDataFrame([bar("half", D(2024, 1, 2), 1.0), bar("nat", D(2024, 1, 2), 1.0)], BARS)
    native = spark.createDataFrame([(*bar("nat", D(2024, 1, 5), 9.0), "w")], BARS + ", frequency string")
    cached = [(*bar(s, D(2024, 1, d), 5.0), "mock" if (s, d) == ("bad", 4) else "vendor_a" if d == 3 else "exchange") for s in ("half", "nat", "old", "bad") for d in (2, 3, 4)]
    cache = spark.createDataFrame(cached, BARS + ", source string")
    wanted = spark.createDataFrame([(s, f) for s in ("half", "nat", "old", "bad", "none") for f in "dw"], "symbol string, frequency string")
    origin = {(r["symbol"], r["frequency"]): (r["origin"], r["sources"]) for r in bars.origins(wanted, provider, native, cache).collect()}
    assert origin == {
        ("half", "d"): ("provider", None), ("half", "w"): ("provider_resampled", None), ("nat", "d"): ("provider", None), ("nat", "w"): ("native", None),
        ("old", "d"): ("cache", "exchange+vendor_a"), ("old", "w"): ("cache_resampled", "exchange+vendor_a"), ("bad", "d"): ("refused", None), ("bad", "w"): ("refused", None),
        ("none", "d"): ("missing", None), ("none", "w"): ("missing", None),
    }
    rows = bars.read_through(wanted, provider, native, cache).collect()
    assert sorted((r["symbol"], r["frequency"], r["open"]) for r in rows) == [("half", "d", 1.0), ("half", "w", 1.0), ("nat", "d", 1.0), ("nat", "w", 9.0)] + [("old", "d", 5.0)] * 3 + [("old", "w", 5.0)]


# ---------------------------------------------------------------- X19


def answer(**k):
    good = {"event_type": "contract", "direction": 0.5, "strength": 1, "summary": "公告", "source_quote": "中标"}
    return json.dumps({a: b for a, b in (good | k).items() if b is not ...}, ensure_ascii=False)


def test_each_refusal(spark):
    cases = [
        (answer(), None), (answer(horizon_days=250), None), ("{", "malformed"), ("[]", "malformed"), ("", "malformed"), (answer(direction="up"), "malformed"), (answer(horizon_days=1.5), "malformed"),
        (answer(more=1), "additional"), (answer(strength=...), "missing"), (answer(summary=None), "missing"), (answer(event_type="rumour"), "event_type"), (answer(direction=1.01), "direction"),
        (answer(strength=-0.1), "strength"), (answer(horizon_days=0), "horizon"), (answer(summary=" "), "summary"), (answer(summary="english"), "summary"), (answer(summary="公" * 121), "summary"),
        (answer(source_quote=" "), "quote"), (answer(source_quote="回购"), "quote_absent"), (None, "unavailable"),
    ]
    df = spark.createDataFrame([(i, "某公司中标项目", a) for i, (a, _) in enumerate(cases)], "id long, title string, answer string")
    got = {r["id"]: r["refusal"] for r in extract.answers(df).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    rows, away = extract.classify(df)
    by = {r["id"]: (r["subtype"], r["direction"], r["origin"]) for r in rows.collect()}
    assert by[0] == ("contract", 0.5, "model") and {v for i, v in by.items() if i > 1} == {("contract", 0.5, "rule")}
    assert away.count() == len(cases) - 3


def test_rules_and_one_event_a_disclosure(spark):
    titles = ["预增 公告", "减持 与 分红", "问询", "nothing", None]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    got = {r["id"]: r["r"] for r in df.select("id", extract.by_rule(F.col("title")).alias("r")).collect()}
    assert [(got[i]["subtype"], got[i]["direction"], got[i]["quote"]) for i in range(5)] == [
        ("earnings", 0.5, "预增"), ("dividend", 0.5, "分红"), ("regulation", -0.5, "问询"), ("other", 0.0, "nothing"), ("other", 0.0, ""),
    ]
    t = lambda h: dt.datetime(2024, 1, 1, h)
    had = spark.createDataFrame([("disclosure:1", "other", 0.0, 0.5, t(0)), ("disclosure:2", "other", 0.0, 0.7, t(0)), ("disclosure:9", "other", 0.0, 0.9, t(0))], "source_ref string, subtype string, direction double, strength double, at timestamp_ntz")
    new = spark.createDataFrame([(1, "contract", 1.0, 0.6, t(2)), (1, "other", 0.0, 0.1, t(1)), (2, "contract", 1.0, 0.8, t(1)), (3, "other", 0.0, 0.2, t(1)), (None, "other", 0.0, 0.2, t(1))], "id int, subtype string, direction double, strength double, at timestamp_ntz")
    rows = {r["source_ref"]: (r["subtype"], r["strength"], r["notice"]) for r in extract.persist(had, new).collect()}
    assert rows == {"disclosure:1": ("contract", 0.6, True), "disclosure:2": ("contract", 0.8, False), "disclosure:3": ("other", 0.2, True), "disclosure:9": ("other", 0.9, False)}


# ---------------------------------------------------------------- S12, S16


def test_lists_and_tables_of_pages(spark):
    pages = [
        (1, "<ul><LI class=x><a href='/a?b=1&amp;c'>One &amp;lt; <b>two</b></a><li>none</li><li><a name=q href=\"/c\">\n Three </a></ul><!-- <li><a href='/no'>no</a> --><script>'<li><a href=\"/no\">no</a>'</script>"),
        (2, None), (3, ""), (4, "<li><a href='/x'></a><lithium><a href='/y'>y</a>"), (5, "<li>" * 50_000 + "<a href='/z'>z</a>" + "<" * 50_000),
    ]
    df = spark.createDataFrame(pages, "page_id int, html string")
    assert sorted(tuple(r) for r in markup.links(df).collect()) == [(1, 1, "/a?b=1&amp;c", "One &lt; two"), (1, 2, "/c", "Three"), (5, 1, "/z", "z")]
    head = "<table><tr><th>Day<th>Other</th><th> Rate </th></tr>"
    tables = [
        (1, "<table><tr><td>Day</td></tr><tr><td>x</td></tr></table>" + head + "<tr><td>2024-01-02<td>q<td>700<tr><td>2024-01-03</td><td>q</td><td><b>707</b></td></tr><tr><td>bad</td><td>q</td><td>9</td></tr><tr><td>2024-01-09</td></tr><tr><td>2024-01-08</td><td>q</td><td>-1</td></tr></table>"),
        (2, head + "</table>"), (3, "<table><tr><td>Day</td></tr></table>"), (4, None), (5, head + "<tr><td>2024-01-02</td><td></td><td>5</td></tr>"),
    ]
    rows = markup.table_rows(spark.createDataFrame(tables, "page_id int, html string"), ["Day", "Rate"])
    assert sorted((r["page_id"], r["row"]) for r in rows.collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (5, 1)]
    got = {r["page_id"]: tuple(r)[1:] for r in markup.parity(rows, "Day", "Rate").collect()}
    assert got == {1: (D(2024, 1, 3), 7.07, 1.0), 5: (D(2024, 1, 2), 0.05, None)}


# ---------------------------------------------------------------- S8


def test_quotes_from_files_of_bytes(spark, tmp_path):
    fields = ["名称 ", "1.5", "2", "x", "3", "1", "", "", "100", "7"]
    timed = fields + [""] * 20 + ["2024-01-02", "15:00:01"]
    text = "\n".join(['var hq_str_bj430047="' + ",".join(fields) + '";', 'var hq_str_sh600000="' + ",".join(timed) + '";', 'var hq_str_sz000001="a,1";', 'var hq_str_sz000002="' + "," * 12 + '";', "junk"])
    (tmp_path / "a.txt").write_bytes(text.encode("gb18030") + b"\n\xff\xff")
    (tmp_path / "b.txt").write_bytes(b"")
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    got = sorted(quotes.snapshot(quotes.decoded(raw)).collect(), key=lambda r: r["symbol"])
    assert [(r["market"], r["symbol"], r["name"], r["open"], r["last"], r["volume"], r["at"]) for r in got] == [
        ("bj", "430047", "名称", 1.5, None, 100.0, None), ("sh", "600000", "名称", 1.5, None, 100.0, dt.datetime(2024, 1, 2, 15, 0, 1)),
    ]


def test_factor_events_become_intervals(spark):
    e = spark.createDataFrame([("a", D(2024, 1, 5), "1.5"), ("a", D(2024, 1, 1), "1"), ("a", D(2024, 1, 5), "1.4"), ("a", D(2024, 1, 9), "-2"), ("b", None, "1")], "symbol string, day date, adj_factor string")
    i = quotes.factor_intervals(e)
    assert sorted(tuple(r) for r in i.select("symbol", "since", F.col("until").cast("string"), "adj_factor").collect()) == [("a", D(2024, 1, 1), "2024-01-04", 1.0), ("a", D(2024, 1, 5), None, 1.5)]
    b = spark.createDataFrame([("a", D(2023, 12, 31)), ("a", D(2024, 1, 4)), ("a", D(2024, 2, 1)), ("b", D(2024, 1, 1))], "symbol string, session date")
    assert sorted((r[0], r[1], r[2]) for r in quotes.factors_of(b, i).collect()) == [("a", D(2023, 12, 31), None), ("a", D(2024, 1, 4), 1.0), ("a", D(2024, 2, 1), 1.5), ("b", D(2024, 1, 1), None)]


# ---------------------------------------------------------------- X42, X46


def test_each_anomaly(spark):
    pub, stat = release.PUBLISHED, release.STATED
    at = lambda d, s=0: dt.datetime(2024, 1, d, 16, 0, s)
    cases = [
        (json.dumps({"available_time_basis": pub, "pub_dates": ["2024-01-04"]}), at(4), None), (json.dumps({"available_time_basis": pub, "pub_dates": ["20240104", "x"]}), at(4, 1), None),
        (json.dumps({"available_time_basis": pub, "pub_dates": ["2024-01-04"]}), at(4, 2), "available_time_mismatch"), (json.dumps({"available_time_basis": stat, "stat_date": "2023-11-21"}), at(4), None),
        ("{", at(4), "malformed_payload"), ("[1]", None, "malformed_payload"), ("", at(4), "malformed_payload"), (json.dumps({"available_time_basis": pub}), None, "missing_available_time"), (None, at(4), "unsupported_basis"),
        ("{}", at(4), "unsupported_basis"), (json.dumps({"available_time_basis": pub, "pub_dates": []}), at(4), "basis_fields_missing"), (json.dumps({"available_time_basis": stat, "stat_date": "2023-13-01"}), at(4), "basis_fields_missing"),
        (json.dumps({"available_time_basis": pub, "pub_dates": "2024-01-04"}), at(4), "basis_fields_missing"),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(cases)], "id int, payload string, available timestamp_ntz")
    audited = release.availability_audit(df)
    got = {r["id"]: r["anomaly"] for r in audited.collect()}
    assert [got[i] for i in range(len(cases))] == [want for *_, want in cases]
    counts = {r["anomaly"]: r["n"] for r in release.anomaly_counts(audited).collect()}
    assert counts["none"] == 3 and counts["malformed_payload"] == 3 and sum(counts.values()) == len(cases) and len(counts) == 6


def test_causes_and_gate(spark):
    families = [("financial", "insufficient"), ("valuation", "insufficient"), ("price", "insufficient"), ("flow", "insufficient"), ("price", "sufficient"), ("price", "live_only"), ("flow", "probe_error")]
    status = spark.createDataFrame([(f"f{i}", *x) for i, x in enumerate(families)], "factor string, family string, status string")
    schema = "coverage double, anomalies long, positive long, valuation_anomalies long, without_factor long, without_bar long"
    fixed = [None, "live_only", "probe_error"]
    for row, want in (
        ((0.5, 0, 0, 0, 1, 0), ["input_data_gap"] * 3), ((0.9, 1, 1, 1, 0, 1), ["pit_data_error", "pit_data_error", "input_data_gap"]), ((0.9, 0, 1, 0, 0, 0), ["suspected_factor_path_bug"] * 3),
        ((None, 0, 1, 0, 0, 0), ["input_data_gap", "suspected_factor_path_bug", "suspected_factor_path_bug"]),
    ):
        audits = spark.createDataFrame([row], schema)
        got = {r["factor"]: r["cause"] for r in release.causes(status, audits, 0.9).collect()}
        assert [got[f"f{i}"] for i in range(7)] == [*want, "suspected_factor_path_bug", *fixed]
    rules = [("a", "blocker", F.col("coverage"), F.col("coverage") < 0.9), ("b", "warning", F.col("anomalies"), F.col("anomalies") > 0)]
    for row, failed, ready in (((0.95, 3, 0, 0, 0, 0), [False, True], True), ((None, 0, 0, 0, 0, 0), [True, False], False)):
        got = release.gate(spark.createDataFrame([row], schema), rules).collect()
        assert [r["failed"] for r in got] == failed and {r["ready"] for r in got} == {ready}
