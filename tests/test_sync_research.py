"""Incremental factors, snapshots, repairs, train-only weights and the forecast view on small fixtures."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F
from tidemark.operators import forecasts, research, sync

D = dt.date


def day(i):
    return D(2024, 1, 1) + dt.timedelta(days=i)


# ---------------------------------------------------------------- X41


def test_request_windows_are_the_missing_days(spark):
    bars = spark.createDataFrame([(s, day(i)) for s in "abcdef" for i in range(0, 20, 2)], "symbol string, session date")
    known = [("b", 4, "v"), ("b", 18, "v"), ("c", 0, "v"), ("c", 6, "v"), ("d", 4, "v"), ("d", 6, "w"), ("e", 0, "v"), ("e", 18, "v")]
    k = spark.createDataFrame([(s, day(i), 1.0, v) for s, i, v in known], "symbol string, session date, adj_factor double, source string")
    got = sorted(tuple(r) for r in sync.request_windows(bars, k).where("symbol <> 'f'").collect())
    assert got == [
        ("a", "all", day(0), day(18), None), ("b", "head", day(0), day(3), "v"), ("c", "tail", day(7), day(18), "v"),
        ("d", "head", day(0), day(3), "w"), ("d", "tail", day(7), day(18), "w"),
    ]
    late = sync.request_windows(bars, k, start="2024-01-03", refresh=True).where("symbol in ('a', 'b', 'e')")
    assert sorted(tuple(r) for r in late.collect()) == [
        ("a", "all", day(2), day(18), None), ("b", "head", day(2), day(3), "v"), ("b", "refresh", day(18), day(18), "v"), ("e", "refresh", day(18), day(18), "v"),
    ]


def test_a_symbol_fails_as_a_whole(spark):
    bars = spark.createDataFrame([(s, day(i)) for s in "abcde" for i in range(6)], "symbol string, session date")
    schema = "symbol string, session date, adj_factor double, source string"
    known = spark.createDataFrame([("a", day(2), 1.0, "v"), ("b", day(2), 1.0, "v"), ("e", day(0), 1.0, "v"), ("e", day(5), 1.0, "v")], schema)
    rows = [("a", day(i), 2.0, "v") for i in range(6)] + [("b", day(0), 2.0, "v"), ("b", day(5), 2.0, "w")] + [("c", day(1), 3.0, "w"), ("c", day(1), 2.5, "w")]
    merged, report = sync.sync_factors(bars, known, spark.createDataFrame(rows, schema))
    assert {r["symbol"]: (r["status"], r["requested"], r["received"], r["covered"]) for r in report.collect()} == {
        "a": ("synced", 2, 5, True), "b": ("source_changed", 2, 2, True), "c": ("synced", 1, 2, True), "d": ("no_data", 1, 0, False), "e": ("skipped", 0, 0, True),
    }
    got = {(r["symbol"], r["session"]): (r["adj_factor"], r["source"]) for r in merged.collect()}
    assert got[("a", day(2))] == (1.0, "v") and got[("a", day(0))] == (2.0, "v") and got[("c", day(1))] == (2.5, "w")
    assert [k for k in got if k[0] == "b"] == [("b", day(2))] and len(got) == 10
    again, second = sync.sync_factors(bars, merged, spark.createDataFrame(rows, schema))
    assert sorted(again.collect()) == sorted(merged.collect()) and {r["status"] for r in second.where("symbol = 'a'").collect()} == {"skipped"}


# ---------------------------------------------------------------- S24


def facts(spark, rows):
    return spark.createDataFrame(rows, "symbol string, metric string, value decimal(10,2), note string").withColumn("value", F.col("value").cast("decimal(10,2)"))


@pytest.fixture()
def snapshot(spark, tmp_path):
    from decimal import Decimal

    rows = [(f"s{i}", "ab"[i % 2], Decimal(i), None if i % 3 else "n") for i in range(40)]
    path = str(tmp_path / "snap")
    sync.export_snapshot(facts(spark, rows), path, "metric")
    return rows, path


def test_an_import_adds_what_is_new_and_only_once(spark, snapshot):
    rows, path = snapshot
    target = facts(spark, rows[:10])
    once, counts = sync.import_snapshot(target, path, ["symbol", "metric"])
    assert counts == {"new": 30, "same": 10} and sorted(map(str, once.collect())) == sorted(map(str, facts(spark, rows).collect()))
    twice, counts = sync.import_snapshot(once, path, ["symbol", "metric"])
    assert counts == {"new": 0, "same": 40} and twice.count() == 40


def test_a_conflict_refuses_the_whole_import(spark, snapshot):
    rows, path = snapshot
    other = [(*rows[3][:3], "changed")] + rows[4:6]
    with pytest.raises(sync.SnapshotError, match="1 rows contradict"):
        sync.import_snapshot(facts(spark, other), path, ["symbol", "metric"])


def test_damaged_missing_and_added_partitions_are_refused(spark, snapshot, tmp_path):
    rows, path = snapshot
    part = f"{path}/rows/metric=a"
    facts(spark, [r for r in rows if r[1] == "a"][:-1]).drop("metric").write.mode("overwrite").parquet(part)  # a row is lost
    with pytest.raises(sync.SnapshotError, match=": a"):
        sync.read_snapshot(spark, path)
    facts(spark, [(s, m, v, "x") for s, m, v, _ in rows if m == "a"]).drop("metric").write.mode("overwrite").parquet(part)  # as many, but other ones
    with pytest.raises(sync.SnapshotError):
        sync.read_snapshot(spark, path)
    facts(spark, [r for r in rows if r[1] == "a"]).drop("metric").write.mode("overwrite").parquet(part)
    assert sync.read_snapshot(spark, path).count() == 40
    facts(spark, rows[:1]).drop("metric").write.parquet(f"{path}/rows/metric=c")
    with pytest.raises(sync.SnapshotError, match=": c"):
        sync.read_snapshot(spark, path)


# ---------------------------------------------------------------- C18


def bars(spark, rows):
    return spark.createDataFrame(rows, "symbol string, session date, open double, high double, low double, close double, y int, source string")


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    good = lambda s, d, y, **k: (s, d, 2.0, k.get("high", 3.0), 1.0, 2.5, y, k.get("source", "exchange"))
    rows = [good(s, D(2019, 1, 2), 2019) for s in "abc"]
    rows += [good("a", D(2020, 1, 2), 2020, source="mock"), good("b", D(2020, 1, 2), 2020), good("c", D(2020, 1, 4), 2020)]  # the last on a Saturday
    rows += [good("a", D(2021, 1, 4), 2021, high=0.5), good("b", D(2021, 1, 4), 2021, high=float("nan")), good("c", D(2021, 1, 4), 2021)]
    rows += [good("a", D(2022, 1, 3), 2022, source="mock")]
    path, away = str(tmp_path / "t"), str(tmp_path / "q")
    df = bars(spark, rows)
    df.repartition(2).write.partitionBy("y").parquet(path)
    files = lambda y: sorted((f, os.stat(f).st_mtime_ns) for f in glob.glob(f"{path}/y={y}/*.parquet"))
    clean, dirty = files(2019), files(2021)

    def table():
        return spark.read.schema(df.schema).parquet(path).select(*df.columns)

    fetched = bars(spark, [good("a", D(2021, 1, 4), 2021, high=9.0), good("b", D(2021, 1, 4), 2021, high=0.1), good("c", D(2021, 1, 4), 2021, high=7.0)])
    report = {r["y"]: tuple(r)[1:] for r in sync.repair_partitions(sync.faults(table()), path, away, "y", fetched).collect()}
    assert report == {2020: (3, 2, 0, 1), 2021: (3, 2, 1, 2), 2022: (1, 1, 0, 0)}
    assert files(2019) == clean and files(2021) != dirty and not os.path.exists(f"{path}/y=2022")
    left = {(r["symbol"], r["y"]): r["high"] for r in table().collect()}
    assert left == {("a", 2019): 3.0, ("b", 2019): 3.0, ("c", 2019): 3.0, ("b", 2020): 3.0, ("a", 2021): 9.0, ("c", 2021): 3.0}
    gone = sorted((r["symbol"], r["y"], r["fault"]) for r in spark.read.parquet(away).collect())
    assert gone == [("a", 2020, "mock"), ("a", 2021, "invalid"), ("a", 2022, "mock"), ("b", 2021, "invalid"), ("c", 2020, "weekend")]
    every = {y: files(y) for y in (2019, 2020, 2021)}
    assert sync.repair_partitions(sync.faults(table()), path, away, "y").count() == 0
    assert {y: files(y) for y in (2019, 2020, 2021)} == every and spark.read.parquet(away).count() == 5


def test_orphan_factors(spark):
    factors = spark.createDataFrame([("a", day(0), 1.0), ("a", day(1), 1.0), ("b", day(0), 1.0)], "symbol string, session date, adj_factor double")
    b = spark.createDataFrame([("a", day(0)), ("a", day(0)), ("b", day(3))], "symbol string, session date")
    assert sorted((r["symbol"], r["session"], r["fault"] or "") for r in sync.orphans(factors, b).collect()) == [("a", day(0), ""), ("a", day(1), "orphan"), ("b", day(0), "orphan")]


# ---------------------------------------------------------------- C8


def market(spark, sessions=20, after=None):
    import random

    rng, noise = random.Random(3), random.Random(4)
    px, wide = [], []
    for s in range(12):
        level = 100.0
        for i in range(sessions):
            z = rng.gauss(0, 1)
            test = after is not None and i >= after
            values = (z, z + 0.3 * rng.gauss(0, 1), z + 0.75 * rng.gauss(0, 1), rng.gauss(0, 1))
            px.append((f"{s:02d}", day(i), noise.random() * 900 if test else level))
            wide.append((f"{s:02d}", day(i), *((noise.gauss(0, 9),) * 4 if test else values)))
            level *= 1 + 0.02 * z + 0.01 * rng.gauss(0, 1)
    return spark.createDataFrame(px, "symbol string, session date, px double"), spark.createDataFrame(wide, "symbol string, session date, z_a double, z_b double, z_c double, z_d double")


def weights(spark, **k):
    px, wide = market(spark, **k)
    return {r["factor"]: r for r in research.train_weights(px, wide, ["a", "b", "c", "d"], 20, 0.7, every=2).collect()}


def test_weights_do_not_see_test_sessions(spark):
    one, other = weights(spark), weights(spark, after=14)
    for f in "abcd":
        assert (one[f]["weight"], one[f]["n"], one[f]["grp"]) == (other[f]["weight"], other[f]["n"], other[f]["grp"])
        assert one[f]["n"] == 13  # the last of 14 training sessions has no future inside the window
    assert abs(sum(abs(r["weight"]) for r in one.values()) - 1) < 1e-12
    assert one["a"]["class"] == "significant_positive" and one["a"]["weight"] > 0


def test_groups_are_closed_over_chains(spark):
    corr = spark.createDataFrame([("a", "b", 5, 0.9), ("b", "c", 5, -0.81), ("a", "c", 5, 0.5), ("d", "e", 5, 0.8), ("a", "a", 5, 1.0), ("f", "g", 5, 0.95)], "left string, right string, days int, corr double")
    got = {r["factor"]: r["grp"] for r in research.redundancy(corr, list("abcdefg")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "f": "f", "g": "f"}


def test_one_factor_of_a_group_keeps_its_weight(spark):
    got = weights(spark)
    group = [f for f in "abcd" if got[f]["grp"]]
    best = max(group, key=lambda f: abs(got[f]["ir"]))
    assert len(group) >= 2 and {got[f]["retained"] for f in group} == {best}
    assert all((got[f]["weight"] == 0) == got[f]["redundant"] == (f != best) for f in group)


def test_windows_that_are_too_short_are_errors(spark):
    px, wide = market(spark)
    with pytest.raises(ValueError, match="two sessions"):
        research.train_weights(px, wide, ["a"], 3)
    with pytest.raises(Exception, match="too few sessions"):
        research.train_weights(px, wide, ["a", "b"], 21).collect()
    flat = wide.withColumns({"z_a": F.lit(1.0), "z_b": F.lit(1.0)})
    with pytest.raises(Exception, match="no factor has an information ratio"):
        research.train_weights(px, flat, ["a", "b"], 20).collect()


# ---------------------------------------------------------------- K10, X32, C16


def cross_sections(spark, last_partial=True):
    f = []
    for i in range(6):
        for h in (5, 10, 20):
            for p in "xyz":
                if (i == 5 and h == 20 and p == "z") or (i == 3 and h == 10):
                    continue
                f.append((p, day(i), h, {"x": 2.0, "y": 1.0, "z": 2.0}[p], "m2" if i == 4 and p == "x" else "m1"))
    b = [("bench", day(i), 1.0, "exchange") for i in range(7)]
    b += [(f"s{k}", day(i), 1.0, "exchange" if i < 5 or not last_partial or k < 3 else "mock") for i in range(7) for k in range(10)]
    return spark.createDataFrame(f, "plate string, session date, horizon int, score double, model string"), spark.createDataFrame(b, "symbol string, session date, close double, source string")


def test_the_newest_complete_cross_section_and_why_newer_ones_are_not(spark):
    f, b = cross_sections(spark)
    audited = forecasts.audit(f, b, "bench")
    got = {r["session"]: r["reason"] for r in audited.collect()}
    assert got == {day(0): None, day(1): None, day(2): None, day(3): "horizons", day(4): "models", day(5): "plates"}
    s = forecasts.state(audited, b, "bench").first()
    assert (s["session"], s["newest"], s["stale"], s["warning"]) == (day(2), day(6), True, "partial market")
    assert s["ignored"] == "2024-01-06:plates,2024-01-05:models,2024-01-04:horizons"
    one = forecasts.audit(f.where("session < '2024-01-03'"), b.where("session < '2024-01-03'"), "bench")
    s = forecasts.state(one, b.where("session < '2024-01-03'"), "bench").first()
    assert (s["session"], s["stale"], s["warning"]) == (day(1), False, None)


def test_coverage_and_benchmark_gate(spark):
    f, b = cross_sections(spark)
    f = f.where("model = 'm1' and horizon <> 10").union(f.where("model = 'm1' and horizon = 10"))
    thin = b.where("not (session = '2024-01-02' and symbol = 'bench') and not (session = '2024-01-03' and symbol in ('s1', 's2'))")
    got = {r["session"]: r["reason"] for r in forecasts.audit(f, thin, "bench").collect()}
    assert (got[day(0)], got[day(1)], got[day(2)]) == (None, "benchmark", "coverage")


def test_forecasts_that_lag_a_complete_session_are_an_error(spark):
    f, b = cross_sections(spark, last_partial=False)
    with pytest.raises(Exception, match="lag the newest complete session"):
        forecasts.state(forecasts.audit(f, b, "bench"), b, "bench").collect()
    with pytest.raises(Exception, match="no forecast cross-section"):
        forecasts.state(forecasts.audit(f.where("session > '2024-01-03'"), b, "bench"), b, "bench").collect()


def test_the_view_ranks_and_enriches(spark):
    f, b = cross_sections(spark)
    flows = spark.createDataFrame([(p, day(i), float(i), "a") for p in "xy" for i in range(-3, 3) if not (p == "y" and i == 0)], "plate string, session date, flow double, source string")
    quotes = spark.createDataFrame([("x", "s1", day(2), 0.1), ("x", "s2", day(2), 0.3), ("y", "s3", day(2), None), ("y", "s4", day(2), 0.5), ("x", "s1", day(5), 9.0)], "plate string, symbol string, session date, change double")
    got = forecasts.view(f, forecasts.state(forecasts.audit(f, b, "bench"), b, "bench"), flows, quotes)
    assert sorted((r["plate"], r["rank"], r["recent_flow"], r["leader"]) for r in got.where("horizon = 5").collect()) == [("x", 1, 0.0, "s2"), ("y", 3, None, None), ("z", 2, None, None)]
    assert got.count() == 9
