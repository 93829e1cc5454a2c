"""What comes from providers: bars read through, extracted events, normalised rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.functions import clean
from tidemark.functions.shared import staged
from tidemark.operators import bars as ob
from tidemark.operators import extract, markup
from tidemark.sources import scan

from .registry import DAILY, TICKS, query

# ---------------------------------------------------------------- X21

#: Symbols by their number modulo 4: the provider has nothing, all days, all days and weeks of its own, or only the days before
#: 1998 (it is not filled up). Of those it has nothing of, every other one's cache has a row that is not audited.
THROUGH = f"""{DAILY}, cache AS (SELECT *, CASE WHEN symbol::INT % 8 = 4 AND day(session) = 3 THEN 'mock' WHEN month(session) % 2 = 0 THEN 'vendor_a' ELSE 'exchange' END AS source FROM daily),
prov AS (SELECT symbol, session, open, high, low, close, volume + 1 AS volume, amount FROM daily WHERE symbol::INT % 4 IN (1, 2) OR (symbol::INT % 4 = 3 AND session < DATE '1998-01-01')),
wk AS (SELECT *, session + ((5 - dayofweek(session) + 7) % 7)::INT AS fri FROM prov),
pr AS (SELECT symbol, 'd' AS frequency, session, open, high, low, close, volume, amount, 'provider' AS origin, NULL AS sources FROM prov),
agg AS (SELECT symbol, fri AS p, 'w' AS frequency, * EXCLUDE (symbol, fri) FROM wk UNION ALL SELECT symbol, date_trunc('month', session)::DATE, 'm', * EXCLUDE (symbol, fri) FROM wk),
pm AS (SELECT symbol, frequency, max(session) AS session, arg_min(open, session) AS open, max(high) AS high, min(low) AS low, arg_max(close, session) AS close, sum(volume) AS volume, sum(amount) AS amount FROM agg GROUP BY symbol, frequency, p),
ok AS (SELECT symbol, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM cache WHERE symbol::INT % 4 = 0 GROUP BY 1 HAVING bool_and(source <> 'mock')),
ca AS (SELECT c.*, o.sources FROM cache c JOIN ok o USING (symbol)),
cg AS (SELECT symbol, (session + ((5 - dayofweek(session) + 7) % 7)::INT) AS p, 'w' AS frequency, * EXCLUDE (symbol) FROM ca UNION ALL SELECT symbol, date_trunc('month', session)::DATE, 'm', * EXCLUDE (symbol) FROM ca),
through AS (SELECT * FROM pr
  UNION ALL SELECT *, CASE WHEN frequency = 'w' AND symbol::INT % 4 = 2 THEN 'native' ELSE 'provider_resampled' END, NULL FROM (SELECT symbol, frequency, session, open, high, low, close, CASE WHEN frequency = 'w' AND symbol::INT % 4 = 2 THEN volume + .5 ELSE volume END, amount FROM pm)
  UNION ALL SELECT symbol, 'd', session, open, high, low, close, volume, amount, 'cache', sources FROM ca
  UNION ALL SELECT symbol, frequency, max(session), arg_min(open, session), max(high), min(low), arg_max(close, session), sum(volume), sum(amount), 'cache_resampled', any_value(sources) FROM cg GROUP BY symbol, frequency, p)"""


def places(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    # written once: each place and frequency reads them with other columns
    d, s = staged(a.daily_bars(spark, sf), "daily-bars"), F.col("symbol").cast("int")
    source = F.when((s % 8 == 4) & (F.dayofmonth("session") == 3), "mock").when(F.month("session") % 2 == 0, "vendor_a").otherwise("exchange")
    provider = d.where((s % 4).isin(1, 2) | ((s % 4 == 3) & (F.col("session") < "1998-01-01"))).withColumn("volume", F.col("volume") + 1)
    native = ob.resampled(provider.where(s % 4 == 2), "w").withColumn("volume", F.col("volume") + 0.5).withColumn("frequency", F.lit("w"))
    wanted = d.select("symbol").distinct().withColumn("frequency", F.explode(F.array(*map(F.lit, "dwm"))))
    return wanted, provider, native, d.withColumn("source", source)


@query("x21_read_through_bars", "symbol frequency session origin sources", "open high low close volume amount", f"WITH {THROUGH} SELECT * FROM through")
def x21(spark, sf):
    return ob.read_through(*places(spark, sf))


@query(
    "x21_bar_origins", "symbol frequency origin sources", "",
    f"""WITH {THROUGH} SELECT s.symbol, f.frequency, CASE WHEN f.frequency = 'w' AND s.symbol::INT % 4 = 2 THEN 'native' WHEN p.symbol IS NOT NULL THEN CASE WHEN f.frequency = 'd' THEN 'provider' ELSE 'provider_resampled' END
      WHEN o.symbol IS NOT NULL THEN CASE WHEN f.frequency = 'd' THEN 'cache' ELSE 'cache_resampled' END
      WHEN (SELECT bool_and(source <> 'mock') FROM cache c WHERE c.symbol = s.symbol) THEN CASE WHEN f.frequency = 'd' THEN 'cache' ELSE 'cache_resampled' END ELSE 'refused' END AS origin,
      CASE WHEN p.symbol IS NULL THEN coalesce(o.sources, (SELECT string_agg(DISTINCT source, '+' ORDER BY source) FROM cache c WHERE c.symbol = s.symbol HAVING bool_and(source <> 'mock'))) END AS sources
    FROM (SELECT DISTINCT symbol FROM daily) s CROSS JOIN (VALUES ('d'), ('w'), ('m')) f(frequency) LEFT JOIN (SELECT DISTINCT symbol FROM prov) p USING (symbol) LEFT JOIN ok o USING (symbol)""",
)
def x21_origins(spark, sf):
    return ob.origins(*places(spark, sf))


# ---------------------------------------------------------------- X19

#: A disclosure for each event; the answers are made of its columns, and some of them are cut, of another type, or say what the
#: title does not.
ANSWERS = f"""{TICKS}, di AS (SELECT event_id AS id, ts AS seen, event_type || ' 公告 ' || CASE event_id % 3 WHEN 0 THEN '预增' WHEN 1 THEN '处罚' ELSE '' END || symbol AS title,
  CASE event_type WHEN 'purchase' THEN 'contract' WHEN 'error' THEN 'regulation' WHEN 'view' THEN 'other' WHEN 'click' THEN 'buyback' ELSE event_type END AS et, event_id * 37 % 230 - 115 AS dr, round(value * 100)::BIGINT % 115 AS st,
  CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 5 = 0 THEN 'plain' ELSE '公告' || symbol END AS su, CASE WHEN event_id % 13 = 0 THEN 'absent words' WHEN event_id % 17 = 0 THEN '  ' ELSE event_type || ' 公告' END AS qu FROM ticks),
an AS (SELECT *, CASE WHEN id % 41 = 0 THEN NULL WHEN id % 19 = 0 THEN left(js, len(js) - 1) ELSE js END AS answer FROM (SELECT *, '{{"event_type": "' || et || '", "direction": ' || CASE WHEN id % 31 = 0 THEN '"high"' ELSE dr::VARCHAR || 'e-2' END ||
  CASE WHEN id % 29 = 0 THEN '' ELSE ', "strength": ' || st::VARCHAR || 'e-2' END || CASE WHEN id % 23 = 0 THEN ', "more": 1' ELSE '' END || ', "summary": "' || su || '", "source_quote": "' || qu || '"}}' AS js FROM di)),
re AS (SELECT *, CASE WHEN answer IS NULL THEN 'unavailable' WHEN NOT json_valid(answer) OR id % 31 = 0 THEN 'malformed' WHEN id % 23 = 0 THEN 'additional' WHEN id % 29 = 0 THEN 'missing' WHEN et NOT IN ('contract', 'regulation', 'other', 'buyback') THEN 'event_type'
  WHEN dr NOT BETWEEN -100 AND 100 THEN 'direction' WHEN st NOT BETWEEN 0 AND 100 THEN 'strength' WHEN NOT regexp_matches(su, '[一-鿿]') THEN 'summary' WHEN trim(qu) = '' THEN 'quote' WHEN NOT contains(title, qu) THEN 'quote_absent' END AS refusal FROM an),
cl AS (SELECT id, seen, CASE WHEN refusal IS NULL THEN et WHEN id % 3 = 0 THEN 'earnings' WHEN id % 3 = 1 THEN 'regulation' ELSE 'other' END AS subtype,
  CASE WHEN refusal IS NULL THEN dr / 100.0::DOUBLE WHEN id % 3 = 0 THEN .5 WHEN id % 3 = 1 THEN -.5 ELSE 0 END AS direction, CASE WHEN refusal IS NULL THEN st / 100.0::DOUBLE ELSE .5 END AS strength,
  CASE WHEN refusal IS NULL THEN qu WHEN id % 3 = 0 THEN '预增' WHEN id % 3 = 1 THEN '处罚' ELSE title END AS quote, CASE WHEN refusal IS NULL THEN 'model' ELSE 'rule' END AS origin FROM re)"""


def disclosures(spark, sf) -> DataFrame:
    i, t = F.col("event_id"), a.ticks(spark, sf)
    kind = F.when(F.col("event_type") == "purchase", "contract").when(F.col("event_type") == "error", "regulation").when(F.col("event_type") == "view", "other").when(F.col("event_type") == "click", "buyback").otherwise(F.col("event_type"))
    direction = F.when(i % 31 == 0, '"high"').otherwise(F.concat((i * 37 % 230 - 115).cast("string"), F.lit("e-2")))
    strength = F.when(i % 29 == 0, "").otherwise(F.concat(F.lit(', "strength": '), (F.round(F.col("value") * 100).cast("long") % 115).cast("string"), F.lit("e-2")))
    summary = F.when(i % 7 == 0, "").when(i % 5 == 0, "plain").otherwise(F.concat(F.lit("公告"), "symbol"))
    quote = F.when(i % 13 == 0, "absent words").when(i % 17 == 0, "  ").otherwise(F.concat("event_type", F.lit(" 公告")))
    more = F.when(i % 23 == 0, ', "more": 1').otherwise("")
    js = F.concat(F.lit('{"event_type": "'), kind, F.lit('", "direction": '), direction, strength, more, F.lit(', "summary": "'), summary, F.lit('", "source_quote": "'), quote, F.lit('"}'))
    title = F.concat("event_type", F.lit(" 公告 "), F.when(i % 3 == 0, "预增").when(i % 3 == 1, "处罚").otherwise(""), "symbol")
    answer = F.when(i % 41 == 0, None).when(i % 19 == 0, F.expr("left(js, length(js) - 1)")).otherwise(F.col("js"))
    return t.withColumn("js", js).select(i.alias("id"), F.col("ts").alias("at"), title.alias("title"), answer.alias("answer"))


@query("x19_extracted_events", "id subtype quote origin", "direction strength", f"WITH {ANSWERS} SELECT * FROM cl")
def x19(spark, sf):
    return extract.classify(disclosures(spark, sf))[0]


@query("x19_refused_answers", "refusal n", "", f"WITH {ANSWERS} SELECT coalesce(refusal, 'accepted') AS refusal, count(*) AS n FROM re GROUP BY 1")
def x19_refused(spark, sf):
    return extract.answers(disclosures(spark, sf)).groupBy(F.coalesce("refusal", F.lit("accepted")).alias("refusal")).agg(F.count("*").alias("n"))


@query(
    "x19_persisted_events", "source_ref subtype notice", "strength",
    f"""WITH {ANSWERS}, had AS (SELECT 'disclosure:' || id AS source_ref, 'other' AS subtype, .55::DOUBLE AS strength FROM cl WHERE id % 4 = 0 OR id % 6 = 1), nw AS (SELECT 'disclosure:' || id AS source_ref, * FROM cl WHERE id % 4 <> 3)
    SELECT n.source_ref, n.subtype, h.source_ref IS NULL OR n.strength >= .6 AS notice, n.strength FROM nw n LEFT JOIN had h USING (source_ref) UNION ALL SELECT source_ref, subtype, false, strength FROM had WHERE source_ref NOT IN (SELECT source_ref FROM nw)""",
)
def x19_persisted(spark, sf):
    rows = extract.classify(disclosures(spark, sf))[0]
    ref = F.concat(F.lit("disclosure:"), F.col("id").cast("string"))
    had = rows.where("id % 4 = 0 OR id % 6 = 1").select(ref.alias("source_ref"), F.lit("other").alias("subtype"), F.lit(0.0).alias("direction"), F.lit(0.55).alias("strength"), "at")
    return extract.persist(had, rows.where("id % 4 <> 3"))


# ---------------------------------------------------------------- S6, S13, P6


@query(
    "s6_normalised_bars", "session n volumes", "close",
    """SELECT l_shipdate::DATE AS session, count(*) AS n, count(*) FILTER (l_linenumber <> 5) AS volumes, sum(l_extendedprice) AS close FROM lineitem
    WHERE l_orderkey % 7 <> 0 AND l_linenumber NOT IN (3, 4) GROUP BY 1""",
)
def s6(spark, sf):
    line = F.col("l_linenumber")
    raw = a.table(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 7 == 0, "no day").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("Date"),
        F.when(line == 3, "NaN").when(line == 4, "-Infinity").otherwise(F.col("l_extendedprice").cast("string")).alias("Close"), F.when(line == 5, "-").otherwise(F.col("l_quantity").cast("string")).alias("Vol"),
    )
    d = scan.normalise_bars(raw, {"Date": "session", "Close": "close", "Vol": "volume"})
    return d.groupBy("session").agg(F.count("*").alias("n"), F.count("volume").alias("volumes"), F.sum("close").alias("close"))


@query("s13_json_series", "day n", "total", f"WITH {TICKS} SELECT ts::DATE AS day, count(*) AS n, sum(value) AS total FROM ticks WHERE event_id % 10 <> 0 GROUP BY 1")
def s13(spark, sf):
    t = a.ticks(spark, sf)
    pair = F.concat(F.lit('[["'), F.date_format("ts", "yyyy-MM-dd"), F.lit('", "'), F.col("value").cast("string"), F.lit('"], ["no day", 1], ["2024-01-01", "none"]]'))
    lines = t.select(F.when(F.col("event_id") % 10 == 0, F.substring(pair, 1, 9)).otherwise(pair).alias("value"))
    return scan.json_series(lines).groupBy("day").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("p6_padded_codes", "s_suppkey code", "", "SELECT s_suppkey, lpad(s_suppkey::VARCHAR, 6, '0') AS code FROM supplier")
def p6(spark, sf):
    k = F.col("s_suppkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" SH."), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("sz"), k.cast("string"), F.lit(" "))).when(k % 4 == 2, F.concat(F.lit("bj"), k.cast("string"))).otherwise(k.cast("string"))
    return a.table(spark, sf, "supplier").select("s_suppkey", clean.pad_code(raw).alias("code"))


# ---------------------------------------------------------------- S16, S12


@query(
    "s16_page_links", "page_id pos href title", "",
    """WITH i AS (SELECT page_id, unnest(string_split_regex(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '(?i)<li[\\s>]')[2:]) AS item, unnest(range(1, 100000)) AS i FROM (SELECT page_id, html FROM pages WHERE html IS NOT NULL)),
    l AS (SELECT page_id, i, regexp_extract(item, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>', 1) AS href, regexp_extract(item, '(?is)<a\\b[^>]*>(.*?)</a', 1) AS t FROM i WHERE item IS NOT NULL),
    p AS (SELECT page_id, i, href, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM l)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS pos, href, title FROM p WHERE href <> '' AND title <> ''""",
)
def s16(spark, sf):
    return markup.links(a.table(spark, sf, "pages"))


#: A page for each order priority: a table of something else, then one of days and rates, with rows that are cut or impossible.
@query(
    "s12_table_parity", "page_id as_of", "value change_pct",
    """WITH d AS (SELECT o_orderpriority AS page_id, o_orderdate::DATE AS day, count(*) * 100 + day(o_orderdate::DATE) AS rate FROM orders GROUP BY 1, 2, day(o_orderdate::DATE)),
    k AS (SELECT page_id, day, rate / 100.0::DOUBLE AS v FROM d WHERE rate % 7 <> 0 AND day(day) % 5 <> 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY day DESC) AS n, lead(v) OVER (PARTITION BY page_id ORDER BY day DESC) AS before FROM k)
    SELECT page_id, day AS as_of, round(v, 4) AS value, round((v / before - 1) * 100, 4) AS change_pct FROM n WHERE n = 1""",
)
def s12(spark, sf):
    day = F.to_date("o_orderdate")
    d = a.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("page_id"), day.alias("day")).agg(F.count("*").alias("c"))
    rate = F.col("c") * 100 + F.dayofmonth("day")
    shown = F.when(rate % 7 == 0, F.concat(F.lit("-"), rate.cast("string"))).otherwise(rate.cast("string"))
    date = F.when(F.dayofmonth("day") % 5 == 0, F.lit("no day")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    # every third row has unclosed cells
    row = F.when(F.dayofmonth("day") % 3 == 0, F.concat(F.lit("<tr><td>x<td> "), date, F.lit("<td><b>"), shown, F.lit("</b>"))).otherwise(F.concat(F.lit('<TR class="r"><td>x</td><td>'), date, F.lit("</td><td>"), shown, F.lit("</td></tr>")))
    rows = d.select("page_id", "day", row.alias("r")).groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("day", "r"))), lambda x: x["r"]), "\n").alias("rows"))  # the days of a page
    html = F.concat(F.lit("<html><!-- <table> --><table><tr><th>Name</th></tr><tr><td>1</td></tr></table><script>'<table>'</script><table><tr><th></th><th>Day</th><th>Rate&nbsp;</th></tr>"), "rows", F.lit("<tr><td>cut</table>"))
    return markup.parity(markup.table_rows(rows.select("page_id", html.alias("html")), ["Day", "Rate"]), "Day", "Rate")
