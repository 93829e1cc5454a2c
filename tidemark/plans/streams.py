"""Streaming jobs over the event files, run to the end of their input; the SQL is the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.functions.shared import shared_dir
from tidemark.sources import pages
from tidemark.streaming import jobs, states

from .registry import TICKS, query


#: The events' files are in no order of time, so their whole span is allowed for; files a batch.
LATE, FILES = "60 days", 3


def stream(spark, sf):
    e = jobs.read(spark, sf, "events.parquet", FILES)
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), a.symbol("user_id").alias("symbol"), "event_type", "value")


@query("t2_minute_breadth", "minute event_type n", "total highest", f"WITH {TICKS} SELECT date_trunc('minute', ts)::VARCHAR AS minute, event_type, count(*) AS n, sum(value) AS total, max(value) AS highest FROM ticks GROUP BY 1, 2")
def t2(spark, sf):
    out = jobs.drain(jobs.minute_breadth(stream(spark, sf), LATE), "update", ["minute", "event_type"])
    return out.withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm:ss"))


@query("t4_unique_events", "symbol n", "total", f"WITH {TICKS} SELECT symbol, count(*) AS n, sum(value) AS total FROM ticks GROUP BY 1")
def t4(spark, sf):
    twice = stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = jobs.drain(jobs.unique_events(twice, "event_id", LATE).drop("copy"))
    return out.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("t9_idempotent_sink", "event_type n", "", f"WITH {TICKS} SELECT event_type, count(*) AS n FROM ticks GROUP BY 1")
def t9(spark, sf):
    twice = stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return jobs.drain(twice, "append", ["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "t7_state_machine", "symbol ref before after", "",
    f"WITH {TICKS}, e AS (SELECT symbol, strftime(ts, '%Y%m%d%H%M%S') || lpad(event_id::VARCHAR, 12, '0') AS ref, event_type AS after FROM ticks), l AS (SELECT *, lag(after) OVER (PARTITION BY symbol ORDER BY ref) AS before FROM e) SELECT symbol, ref, before, after FROM l WHERE before IS DISTINCT FROM after",
)
def t7(spark, sf):
    t = stream(spark, sf).select("symbol", "ts", F.col("event_type").alias("state"), ref().alias("ref"))
    return decided(spark, sf, t, states.transitions, "symbol string, before string, after string, ref string")


def ref():
    return F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.lpad(F.col("event_id").cast("string"), 12, "0"))


def decided(spark, sf, t, decide, schema):
    """What a keyed state decides on all events; they are of any order, so they wait for the heartbeat behind the last one."""
    base = f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    beating = jobs.with_heartbeats(t, f"{base}/beats")
    states.run(beating, base, decide, LATE)
    last = a.ticks(spark, sf).agg((F.max("ts") + F.expr("interval 90 days")).alias("at")).first()["at"]
    jobs.beat(spark, t.schema, f"{base}/beats", "ts", last)
    states.run(beating, base, decide, LATE)
    return states.written(spark, base, schema)


#: Two writers propose each event as the next state of its symbol: one has seen the event before it, the other, at every odd
#: event, only the one before that.
PROPOSALS = f"""{TICKS}, e AS (SELECT symbol, strftime(ts, '%Y%m%d%H%M%S') || lpad(event_id::VARCHAR, 12, '0') AS ref, event_id, event_type FROM ticks),
p AS (SELECT symbol, ref, row_number() OVER w AS i, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS writer, CASE WHEN event_id % 2 = 0 THEN lag(event_type) OVER w ELSE lag(event_type, 2) OVER w END AS expected, event_type AS after
      FROM e WINDOW w AS (PARTITION BY symbol ORDER BY ref)),
r AS (SELECT symbol, 0::BIGINT AS i, NULL::VARCHAR AS ref, NULL::VARCHAR AS writer, NULL::VARCHAR AS before, NULL::VARCHAR AS after, NULL::VARCHAR AS name, 0::BIGINT AS version, NULL::VARCHAR AS status FROM (SELECT DISTINCT symbol FROM p)
      UNION ALL SELECT p.symbol, p.i, p.ref, p.writer, r.name, p.after, CASE WHEN p.after <> r.name IS NOT FALSE AND p.expected IS NOT DISTINCT FROM r.name THEN p.after ELSE r.name END,
      r.version + (p.after <> r.name IS NOT FALSE AND p.expected IS NOT DISTINCT FROM r.name)::BIGINT,
      CASE WHEN p.after = r.name THEN 'unchanged' WHEN p.expected IS DISTINCT FROM r.name THEN 'stale' ELSE 'accepted' END FROM r JOIN p ON p.symbol = r.symbol AND p.i = r.i + 1)"""


@query("c13_compare_and_set", "symbol ref writer before after version status", "", f"WITH RECURSIVE {PROPOSALS} SELECT * FROM r WHERE i > 0")
def c13(spark, sf):
    seen = a.ticks(spark, sf).select("event_id", "symbol", "event_type", ref().alias("ref"))
    w = Window.partitionBy("symbol").orderBy("ref")
    expected = F.when(F.col("event_id") % 2 == 0, F.lag("event_type").over(w)).otherwise(F.lag("event_type", 2).over(w))
    known = seen.select("event_id", expected.alias("expected"))  # what its writer had seen
    t = stream(spark, sf).join(known, "event_id").select(
        "symbol", "ts", ref().alias("ref"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("writer"), "expected", F.col("event_type").alias("state")
    )
    return decided(spark, sf, t, states.compare_and_set, states.DECISION)


@query(
    "t8_gap_sessions", "symbol sessions n", "",
    f"""WITH {TICKS}, g AS (SELECT symbol, ts, (ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) >= INTERVAL 12 HOUR)::INT AS cut FROM ticks) SELECT symbol, sum(coalesce(cut, 0))::BIGINT + 1 AS sessions, count(*) AS n FROM g GROUP BY 1""",
)
def t8(spark, sf):
    t = stream(spark, sf).select("symbol", "ts")
    base = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    sessions = jobs.gap_sessions(jobs.with_heartbeats(t, f"{base}/beats"), "12 hours", LATE)
    jobs.run(sessions, base)
    last = a.ticks(spark, sf).agg((F.max("ts") + F.expr("interval 90 days")).alias("at")).first()["at"]
    if last is not None:
        jobs.beat(spark, t.schema, f"{base}/beats", "ts", last)  # the feed is quiet: its last sessions are closed
        jobs.run(sessions, base)
    out = jobs.written(spark, sessions.schema, base).where("symbol is not null")
    return out.groupBy("symbol").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


FEED = "source string, column string, page long, event_id long, value double"
#: Pages of a column are its hours with events; runs read five of each. Run 2 fails; run 3 gets no column of clicks; run 4 gets
#: all that is left.
LIMIT = 5


@query(
    "t3_checkpointed_pages", "source feed run pages n", "total",
    f"""WITH {TICKS}, p AS (SELECT event_type AS source, 'c' || symbol::INT % 3 AS feed, dense_rank() OVER (PARTITION BY event_type, symbol::INT % 3 ORDER BY date_trunc('hour', ts)) - 1 AS page, value FROM ticks)
    SELECT source, feed, CASE WHEN page < {LIMIT} THEN 1 WHEN page < {2 * LIMIT} AND source <> 'click' THEN 3 ELSE 4 END::BIGINT AS run, count(DISTINCT page) AS pages, count(*) AS n, sum(value) AS total FROM p GROUP BY ALL""",
)
def t3(spark, sf):
    t = a.ticks(spark, sf).withColumn("column", F.concat(F.lit("c"), (F.col("symbol").cast("int") % 3).cast("string"))).withColumnRenamed("event_type", "source")
    hours = t.select("source", "column", F.date_trunc("hour", "ts").alias("hour")).distinct()
    numbered = hours.withColumn("page", F.row_number().over(Window.partitionBy("source", "column").orderBy("hour")) - F.lit(1).cast("long"))  # the hours of a column
    rows = t.withColumn("hour", F.date_trunc("hour", "ts")).join(numbered, ["source", "column", "hour"]).select("source", "column", "page", "event_id", "value")
    base = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    pages.write_pages(rows, f"{base}/feed")
    for run, limit, whole in ((1, LIMIT, lambda s, c: True), (2, LIMIT, lambda s, c: False), (3, LIMIT, lambda s, c: s != "click"), (4, 1 << 40, lambda s, c: True)):
        pages.poll(spark, f"{base}/feed", FEED, base, run, limit, whole)
    got = pages.accepted(spark, FEED, base)
    return got.groupBy("source", F.col("column").alias("feed"), "run").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("n"), F.sum("value").alias("total"))


@query(
    "t10_expected_slots", "slot", "",
    f"WITH {TICKS}, r AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS s) SELECT s::VARCHAR AS slot FROM r WHERE NOT EXISTS (SELECT 1 FROM ticks WHERE event_type = 'click' AND date_trunc('hour', ts) = s)",
)
def t10(spark, sf):
    slots = spark.sql("select explode(sequence(timestamp'2024-01-01', timestamp'2024-01-30 23:00:00', interval 1 hour)) as s")
    seen = a.ticks(spark, sf).where("event_type = 'click'").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("s")).distinct()
    return slots.join(seen, "s", "left_anti").select(F.date_format("s", "yyyy-MM-dd HH:mm:ss").alias("slot"))


@query("x80_slot_matching", "job slot run", "")
def x80(spark, sf):
    t = a.ticks(spark, sf).withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    runs = t.select(F.col("event_type").alias("job"), "at")
    slots = runs.groupBy("job").agg(F.min("at").alias("a"), F.max("at").alias("b")).select("job", F.explode(F.expr("sequence(a - a % 3600, b, 3600)")).alias("at"))
    return jobs.slot_matches(slots, runs, 600)
