"""Streams in bounded batches, over several runs, with late files; the checkpointed source."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from tidemark.sources import pages
from tidemark.streaming import jobs, states

T0 = dt.datetime(2024, 1, 1)
EVENTS = "symbol string, ts timestamp, state string, ref string, writer string, expected string"


def event(symbol, minute, state, writer="a", expected=None):
    return symbol, T0 + dt.timedelta(minutes=minute), state, f"{minute:06d}", writer, expected


def drop(spark, folder, rows):
    """One file."""
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, files=1):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", str(files)).parquet(folder)


def test_states_over_unordered_files_runs_and_a_restart(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [event("s", m, "abc"[m * 7 % 3], "x") for m in range(40)] + [event("t", m, "a") for m in range(0, 40, 3)]
    for k in (3, 0, 2, 1):  # each file has all minutes
        drop(spark, folder, rows[k::4])
    states.run(jobs.with_heartbeats(stream(spark, folder), f"{base}/beats"), base, states.transitions, "60 minutes")
    first = states.written(spark, base, "symbol string, before string, after string, ref string")
    assert first.count() == 0  # all may still be preceded by others
    jobs.beat(spark, stream(spark, folder).schema, f"{base}/beats", "ts", T0 + dt.timedelta(minutes=79))
    states.run(jobs.with_heartbeats(stream(spark, folder), f"{base}/beats"), base, states.transitions, "60 minutes")
    some = states.written(spark, base, "symbol string, before string, after string, ref string").collect()
    assert max(r["ref"] for r in some) == "000019"
    drop(spark, folder, [event("s", 19, "z"), event("s", 41, "z"), event("s", 40, "q")])  # the first comes too late
    jobs.beat(spark, stream(spark, folder).schema, f"{base}/beats", "ts", T0 + dt.timedelta(days=9))
    states.run(jobs.with_heartbeats(stream(spark, folder), f"{base}/beats"), base, states.transitions, "60 minutes")
    got = [tuple(r) for r in states.written(spark, base, "symbol string, before string, after string, ref string").collect()]
    want, last = [("t", None, "a", "000000")], None
    for m, state in [(m, "abc"[m * 7 % 3]) for m in range(40)] + [(40, "q"), (41, "z")]:
        if state != last:
            want.append(("s", last, state, f"{m:06d}"))
            last = state
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_stale_writers_change_is_refused_and_reported(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    drop(spark, folder, [event("s", 1, "open", "a"), event("s", 3, "done", "b", "open"), event("u", 1, "open", "a", "closed")])
    drop(spark, folder, [event("s", 2, "held", "a", "open"), event("s", 4, "done", "a", "held"), event(None, 9, None)])
    drop(spark, folder, [event("s", 5, "done", "b", "open"), event("s", 6, "gone", "b", "done"), event(None, 90, None)])
    states.run(stream(spark, folder), base, states.compare_and_set, "7 minutes")
    drop(spark, folder, [event("s", 91, "back", "a", "done"), event("s", 92, "back", "b", "gone"), event(None, 999, None)])
    states.run(stream(spark, folder), base, states.compare_and_set, "7 minutes")
    got = states.written(spark, base, states.DECISION).collect()
    assert sorted((r["symbol"], r["ref"], r["status"], r["before"], r["version"]) for r in got if r["symbol"] == "s") == [
        ("s", "000001", "accepted", None, 1), ("s", "000002", "accepted", "open", 2), ("s", "000003", "stale", "held", 2), ("s", "000004", "accepted", "held", 3),
        ("s", "000005", "unchanged", "done", 3), ("s", "000006", "accepted", "done", 4), ("s", "000091", "stale", "gone", 4), ("s", "000092", "accepted", "gone", 5),
    ]
    assert [r["status"] for r in got if r["symbol"] == "u"] == ["stale"] and len(got) == 9


def test_sessions_close_by_a_heartbeat(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        drop(spark, folder, [event(s, m, "x") for s in "ab" for m in (0, 1, 2, 30, 31, 32, 90)][k::3])
    t = stream(spark, folder)
    out = jobs.gap_sessions(jobs.with_heartbeats(t, f"{base}/beats"), "10 minutes", "1 day")
    jobs.run(out, base)
    jobs.beat(spark, t.schema, f"{base}/beats", "ts", T0 + dt.timedelta(days=5))
    jobs.run(out, base)
    got = jobs.written(spark, out.schema, base).where("symbol is not null").collect()
    assert sorted((r["symbol"], r["n"]) for r in got) == [(s, n) for s in "ab" for n in (1, 3, 3)]


FEED = "source string, column string, page long, v long"


@pytest.fixture()
def feed(spark, tmp_path):
    rows = spark.range(24).select(F.when(F.col("id") < 12, "x").otherwise("y").alias("source"), F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("column"), (F.col("id") % 12 / 2).cast("long").alias("page"), F.col("id").alias("v"))
    pages.write_pages(rows, str(tmp_path / "feed"))
    return str(tmp_path / "feed"), str(tmp_path / "base")


def got(spark, base):
    return {(r["source"], r["column"], r["page"]): r["run"] for r in pages.accepted(spark, FEED, base).collect()}


def test_failed_runs_are_read_again_and_degraded_ones_where_not_committed(spark, feed):
    at, base = feed
    assert pages.poll(spark, at, FEED, base, 1, 2) == "ok"
    assert pages.poll(spark, at, FEED, base, 2, 2, lambda s, c: False) == "failed"
    assert pages.poll(spark, at, FEED, base, 3, 2, lambda s, c: (s, c) != ("y", "c1")) == "degraded"
    assert pages.poll(spark, at, FEED, base, 4, 100) == "ok"
    assert pages.poll(spark, at, FEED, base, 5, 100) == "ok"  # nothing is left
    run = got(spark, base)
    assert run == {(s, c, p): 1 if p < 2 else 3 if p < 4 and (s, c) != ("y", "c1") else 4 for s in "xy" for c in ("c0", "c1") for p in range(6)}


def test_a_run_without_its_line_counts_for_nothing(spark, feed):
    at, base = feed

    class Lost(Exception):
        pass

    def lost(source, column):
        raise Lost

    pages.poll(spark, at, FEED, base, 1, 1)
    with pytest.raises(Lost):  # its rows are written, its line is not
        pages.poll(spark, at, FEED, base, 2, 3, lost)
    pages.poll(spark, at, FEED, base, 3, 1)
    assert {p: r for (s, c, p), r in got(spark, base).items() if (s, c) == ("x", "c0")} == {0: 1, 1: 3}


def test_which_lines_are_trusted(spark):
    lines = [
        (1, 1, "ok", "s", None, 7, True), (2, 1, "degraded", "s", None, 9, True), (3, 2, "ok", "s", "a", 10, True), (4, 2, "degraded", "s", "a", 11, False),
        (5, 2, "failed", "s", "a", 12, True), (6, 2, "degraded", "s", "a", 13, True), (7, 2, "ok", "s", "a", None, True), (8, 2, "ok", "u", "a", 1, False),
    ]
    trusted = pages.checkpoints(spark.createDataFrame(lines, pages.LOG))
    assert pages.starts(trusted, [("s", "a"), ("s", "b"), ("u", "a")]) == {"s/a": 13, "s/b": 7, "u/a": -1}
