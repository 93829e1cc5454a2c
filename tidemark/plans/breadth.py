"""Breadth, sentiment, monitor feed, nearest-time comparison, forecast drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.operators import market as op
from tidemark.operators import pit

from .factors import WIDE_SQL, wide
from .registry import BARS, TICKS, query

QUOTE = f"""{BARS}, q0 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY session) AS prev FROM bars),
q AS (SELECT symbol, session, (close / nullif(prev, 0) - 1) * 100 AS change, close AS last, high, prev * 1.5 AS limit_up, prev * .6 AS limit_down, amount FROM q0)"""
BREADTH = f"""{QUOTE}, br AS (SELECT session AS ts, count(*) FILTER (change > 0) AS advancers, count(*) FILTER (change < 0) AS decliners, count(*) FILTER (change = 0) AS unchanged,
 count(*) FILTER (last >= limit_up) AS limit_up_n, count(*) FILTER (last <= limit_down) AS limit_down_n, count(*) FILTER (high >= limit_up AND NOT last >= limit_up) AS broken,
 count(*) FILTER (change > 4) AS up_4, count(*) FILTER (change < -4) AS down_4, sum(amount) AS amount, avg(change) AS mean_change, median(change) AS median_change FROM q WHERE change IS NOT NULL GROUP BY 1)"""
COUNTS = "advancers decliners unchanged limit_up_n limit_down_n broken up_4 down_4"


def quotes(spark, sf) -> DataFrame:
    b = a.bars(spark, sf)
    prev = F.lag("close").over(Window.partitionBy("symbol").orderBy("session"))
    b = b.withColumn("prev", prev)
    return b.select("symbol", F.col("session").alias("ts"), ((F.try_divide(F.col("close"), F.col("prev")) - 1) * 100).alias("change"), F.col("close").alias("last"), "high",
                    (F.col("prev") * 1.5).alias("limit_up"), (F.col("prev") * 0.6).alias("limit_down"), "amount")


@query("a2_market_breadth", f"ts {COUNTS}", "amount mean_change median_change", f"WITH {BREADTH} SELECT * FROM br")
def a2(spark, sf):
    return op.breadth(quotes(spark, sf), ["ts"])


def trailing_sql(value: str, out: str, sample: str | None = None, history: int = 250) -> str:
    """SQL of a rank among the last values; needs nn_<out> in the row."""
    s = f"list({sample or value}) FILTER ({sample or value} IS NOT NULL) OVER (ORDER BY nn_{out} RANGE BETWEEN {history - 1} PRECEDING AND CURRENT ROW)"
    return f"""{s} AS s_{out}"""


def rank_sql(value: str, out: str) -> str:
    s = f"s_{out}"
    return (
        f"CASE WHEN {value} IS NULL OR coalesce(len({s}), 0) = 0 THEN NULL WHEN len({s}) = 1 OR list_max({s}) = list_min({s}) THEN 50.0::DOUBLE "
        f"ELSE (len(list_filter({s}, lambda x: x < {value})) + (len(list_filter({s}, lambda x: x = {value})) - 1) / 2.0::DOUBLE) / (len({s}) - 1) * 100 END AS r_{out}"
    )


LABEL = "CASE WHEN {0} < 30 THEN 'coldest' WHEN {0} < 45 THEN 'weak' WHEN {0} < 60 THEN 'neutral' WHEN {0} <= 75 THEN 'strong' ELSE 'hottest' END"
PARTS = {"share": ("share", "share"), "volume": ("volume", "volume"), "ecology": ("ecology", "ecology"), "volatility": ("volatility", "vol0")}
SENT = f"""{BREADTH}, ob AS (SELECT * REPLACE (CASE WHEN amount > 0 THEN amount END AS amount), advancers / nullif(advancers + decliners, 0) AS share, (limit_up_n - broken)::DOUBLE AS ecology, broken * 100.0::DOUBLE / nullif(limit_up_n + broken, 0) AS broken_rate FROM br),
ix AS (SELECT session AS ts, close / nullif(lag(close) OVER (ORDER BY session), 0) - 1 AS r FROM bars WHERE symbol = '000001'),
iv AS (SELECT ts, CASE WHEN count(r) OVER (ORDER BY ts ROWS 19 PRECEDING) = 20 THEN stddev_pop(r) OVER (ORDER BY ts ROWS 19 PRECEDING) * sqrt(252) END AS vol0 FROM ix),
ob2 AS (SELECT ob.*, amount / lag(amount) OVER (ORDER BY ts) - 1 AS volume, vol0, last_value(vol0 IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS volatility FROM ob LEFT JOIN iv USING (ts)),
ob3 AS (SELECT *, {", ".join(f"count({s}) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nn_{k}" for k, (_, s) in PARTS.items())} FROM ob2),
ob4 AS (SELECT *, {", ".join(trailing_sql(v, k, s) for k, (v, s) in PARTS.items())} FROM ob3),
rk0 AS (SELECT *, {", ".join(rank_sql(v, k) for k, (v, _) in PARTS.items())} FROM ob4),
rk AS (SELECT * REPLACE (100 - r_volatility AS r_volatility), {", ".join(f"r_{k} IS NULL OR len(s_{k}) < 2 AS poor_{k}" for k in PARTS)} FROM rk0),
st AS (SELECT *, concat_ws(',', {", ".join(f"CASE WHEN poor_{k} THEN '{k}' END" for k in PARTS)}) AS degraded,
  .3 * coalesce(r_share, 50) + .25 * coalesce(r_volume, 50) + .25 * coalesce(r_ecology, 50) + .2 * coalesce(r_volatility, 50) AS sentiment FROM rk),
sl AS (SELECT *, {LABEL.format("sentiment")} AS label, CASE WHEN NOT poor_ecology THEN {LABEL.format("r_ecology")} END AS money_effect, CASE WHEN NOT poor_volume THEN {LABEL.format("r_volume")} END AS liquidity,
  CASE WHEN NOT poor_volatility THEN {LABEL.format("r_volatility")} END AS risk_hint FROM st)"""


def sentiment(spark, sf) -> DataFrame:
    obs = op.observations(op.breadth(quotes(spark, sf), ["ts"]))
    index = a.bars(spark, sf).where("symbol = '000001'").select(F.col("session").alias("ts"), "close")
    return op.sentiment(obs, index)


@query("c4_sentiment", "ts label degraded money_effect liquidity risk_hint", "share volume ecology volatility r_share r_volume r_ecology r_volatility sentiment", f"WITH {SENT} SELECT * FROM sl")
def c4(spark, sf):
    return sentiment(spark, sf)


FEED = f"""{SENT}, p AS (SELECT *, advancers - decliners AS bal, lag(advancers - decliners) OVER w AS pbal, lag(amount) OVER w AS pa, lag(share) OVER w AS ps, lag(limit_up_n) OVER w AS pl, lag(broken_rate) OVER w AS pr, lag(ts) OVER w AS pt, lag(label) OVER w AS pb FROM sl WINDOW w AS (ORDER BY ts)),
feed AS (SELECT ts, 'amount' AS kind, amount / nullif(pa, 0) - 1 AS delta FROM p WHERE abs(amount / nullif(pa, 0) - 1) >= .05 UNION ALL SELECT ts, 'breadth', share - ps FROM p WHERE (bal > 0 AND pbal < 0) OR (bal < 0 AND pbal > 0)
    UNION ALL SELECT ts, 'limit_up', (limit_up_n - pl)::DOUBLE FROM p WHERE abs(limit_up_n - pl) >= 5 UNION ALL SELECT ts, 'broken', broken_rate FROM p WHERE pt IS NOT NULL AND broken_rate > 30 AND (pr IS NULL OR pr <= 30) UNION ALL SELECT ts, 'label', NULL FROM p WHERE label <> pb)"""


@query("w22_w23_monitor_feed", "ts kind", "delta", f"WITH {FEED} SELECT * FROM feed")
def w22(spark, sf):
    return op.changes(sentiment(spark, sf))


LEAD = """lead0 AS (SELECT session AS ts, 'N' || lpad(s_nationkey::VARCHAR, 2, '0') AS plate, avg(close / open) AS strength FROM bars JOIN supplier ON lpad(s_suppkey::VARCHAR, 6, '0') = symbol GROUP BY 1, 2),
lead1 AS (SELECT ts, plate, strength FROM lead0 QUALIFY row_number() OVER (PARTITION BY ts ORDER BY strength DESC, plate) = 1),
lead2 AS (SELECT ts, plate AS after, strength, lag(plate) OVER (ORDER BY ts) AS before FROM lead1), leads AS (SELECT * FROM lead2 WHERE before <> after)"""


def plate_strength(spark, sf) -> DataFrame:
    j = a.bars(spark, sf).join(a.plates(spark, sf), "symbol")
    return j.groupBy(F.col("session").alias("ts"), "plate").agg(F.avg(F.col("close") / F.col("open")).alias("strength")).withColumn("rank", F.lit(None).cast("int"))


@query("w23_x24_leader_changes", "ts before after", "strength", f"WITH {BARS}, {LEAD} SELECT * FROM leads")
def w23(spark, sf):
    return op.leader_changes(plate_strength(spark, sf))


@query(
    "k11_c14_merged_feed", "ts kind text", "",
    f"""WITH {FEED}, {LEAD}, f AS (SELECT ts, kind, kind AS text, 0 AS n FROM feed WHERE kind <> 'label' UNION ALL SELECT ts, 'label', 'label', 1 FROM feed WHERE kind = 'label' UNION ALL SELECT ts, 'leader', before || '>' || after, 2 FROM leads)
    SELECT ts, kind, text FROM f ORDER BY ts DESC, n DESC, kind DESC, text DESC LIMIT 40""",
)
def k11(spark, sf):
    feed = op.changes(sentiment(spark, sf)).withColumn("text", F.col("kind"))
    leads = op.leader_changes(plate_strength(spark, sf)).select("ts", F.lit("leader").alias("kind"), F.concat("before", F.lit(">"), "after").alias("text"))
    return op.merged_feed([feed.where("kind <> 'label'"), feed.where("kind = 'label'"), leads], 40)


@query(
    "j8_nearest_prior_day", "event_id near_id", "value near_value",
    f"""WITH {TICKS}, c AS (SELECT l.event_id, l.value, r.event_id AS near_id, r.value AS near_value,
      row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch(r.ts)::BIGINT - epoch(l.ts)::BIGINT + 86400), epoch(r.ts)::BIGINT, r.event_id) AS n
      FROM ticks l LEFT JOIN ticks r ON r.event_type = l.event_type AND abs(floor(epoch(r.ts))::BIGINT - floor(epoch(l.ts))::BIGINT + 86400) <= 90)
    SELECT t.event_id, x.near_id, t.value, x.near_value FROM ticks t LEFT JOIN (
      SELECT l.event_id, arg_min(r.event_id, [abs(floor(epoch(r.ts))::BIGINT + 86400 - floor(epoch(l.ts))::BIGINT), floor(epoch(r.ts))::BIGINT, r.event_id]) AS near_id,
             arg_min(r.value, [abs(floor(epoch(r.ts))::BIGINT + 86400 - floor(epoch(l.ts))::BIGINT), floor(epoch(r.ts))::BIGINT, r.event_id]) AS near_value
      FROM ticks l JOIN ticks r ON r.event_type = l.event_type AND abs(floor(epoch(r.ts))::BIGINT + 86400 - floor(epoch(l.ts))::BIGINT) <= 90 GROUP BY 1) x USING (event_id)""",
)
def j8(spark, sf):
    t = a.ticks(spark, sf).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    prior = t.withColumn("ts", F.col("ts") + F.expr("interval 1 day")).groupBy("event_type", F.date_trunc("second", "ts").alias("ts")).agg(F.min_by("value", "event_id").alias("v"), F.min("event_id").alias("id"))
    near = pit.nearest(t, prior, ["event_type"], "ts", 90)
    return near.select("event_id", F.col("id_near").alias("near_id"), "value", F.col("v_near").alias("near_value"))


DRIFT = f"""{WIDE_SQL}, dr AS (SELECT symbol, session, p20 AS p, p20 - lag(p20, 5) OVER (PARTITION BY symbol ORDER BY session) AS dlt FROM wide),
drift AS (SELECT *, CASE WHEN dlt > .08 + 1e-12 THEN 'strengthened' WHEN dlt < -.08 - 1e-12 THEN 'weakened' WHEN dlt IS NOT NULL THEN 'unchanged' END AS drift FROM dr)"""


@query("w27_thesis_drift", "symbol session drift", "p", f"WITH {DRIFT} SELECT * FROM drift")
def w27(spark, sf):
    return op.thesis_drift(wide(spark, sf).select("symbol", "session", F.col("p20").alias("p")))


@query(
    "c20_t7_state_transitions", "symbol session before after", "",
    f"WITH {DRIFT}, s AS (SELECT symbol, session, drift AS after, lag(drift) OVER (PARTITION BY symbol ORDER BY session) AS before FROM drift WHERE drift <> 'unchanged') SELECT * FROM s WHERE before IS DISTINCT FROM after",
)
def c20(spark, sf):
    d = op.thesis_drift(wide(spark, sf).select("symbol", "session", F.col("p20").alias("p"))).where("drift <> 'unchanged'")
    s = d.withColumn("before", F.lag("drift").over(Window.partitionBy("symbol").orderBy("session"))).withColumn("after", F.col("drift"))
    return s.where(~F.col("before").eqNullSafe(F.col("after")))
