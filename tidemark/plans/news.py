"""News: canonical forms, de-duplication, mentions, classes, sampling, evaluation, segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import adapters as a
from tidemark.operators import text as op

from .registry import query


def news(spark, sf) -> DataFrame:
    d = a.table(spark, sf, "documents")
    url = F.concat(F.lit("HTTP://News.Example.ORG//a/"), F.col("source"), F.lit("/"), (F.col("doc_id") % 400).cast("string"), F.lit("?b=2&utm_source=x&a="), (F.col("doc_id") % 3).cast("string"), F.lit("#top"))
    body = op.normalise(F.col("text"))
    return d.select("doc_id", op.canonical_url(url).alias("url"), body.alias("body"), op.content_hash(body).alias("content_hash"), "source", "lang")


NEWS = """news AS (SELECT doc_id, 'http://news.example.org/a/' || source || '/' || (doc_id % 400) || '?a=' || (doc_id % 3) || '&b=2' AS url, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body,
  sha256(coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '')) AS content_hash, source, lang FROM documents)"""


@query("f23_f25_canonical_news", "doc_id url content_hash", "", f"WITH {NEWS} SELECT * FROM news")
def f23(spark, sf):
    return news(spark, sf)


@query(
    "u7_news_dedupe", "doc_id url", "",
    f"WITH {NEWS}, u AS (SELECT * FROM news QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1",
)
def u7(spark, sf):
    return op.dedupe_news(news(spark, sf).drop("body"), ["doc_id"])


RULES = {"alpha": ("the and", "der und"), "beta": ("que la", "de la"), "gamma": ("tion",)}


@query(
    "f27_event_class", "class n", "",
    "SELECT CASE WHEN contains(text, 'the and') OR contains(text, 'der und') THEN 'alpha' WHEN contains(text, 'que la') OR contains(text, 'de la') THEN 'beta' WHEN contains(text, 'tion') THEN 'gamma' ELSE 'other' END AS class, count(*) AS n FROM documents GROUP BY 1",
)
def f27(spark, sf):
    return a.table(spark, sf, "documents").groupBy(op.classify(F.col("text"), RULES).alias("class")).agg(F.count("*").alias("n"))


@query(
    "f26_unique_mention", "id symbol", "",
    """WITH t AS (SELECT event_id AS id, 'code ' || lpad((user_id % 40)::VARCHAR, 6, '0') || CASE WHEN event_id % 3 = 0 THEN ' and ' || lpad((event_id % 30)::VARCHAR, 6, '0') ELSE ' 12345678' END AS text FROM events),
    c AS (SELECT DISTINCT id, unnest(list_filter(regexp_split_to_array(text, '[^0-9]+'), lambda x: len(x) = 6)) AS symbol FROM t),
    o AS (SELECT id, min(symbol) AS symbol FROM c WHERE symbol IN (SELECT lpad(s_suppkey::VARCHAR, 6, '0') FROM supplier) GROUP BY id HAVING count(*) = 1) SELECT t.id, o.symbol FROM t LEFT JOIN o USING (id)""",
)
def f26(spark, sf):
    tail = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" and "), F.lpad((F.col("event_id") % 30).cast("string"), 6, "0"))).otherwise(" 12345678")
    t = a.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("code "), F.lpad((F.col("user_id") % 40).cast("string"), 6, "0"), tail).alias("text"))
    return op.unique_mention(t, a.plates(spark, sf))


@query(
    "f31_protected_facts", "doc_id facts", "",
    "SELECT doc_id, array_to_string(list_sort(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?%?')), '|') AS facts FROM documents",
)
def f31(spark, sf):
    return a.table(spark, sf, "documents").select("doc_id", F.array_join(op.fact_tokens(F.col("text")), "|").alias("facts"))


@query(
    "k12_stratified_sample", "lang source rank doc_id", "",
    "SELECT * FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('gold-1:' || doc_id), doc_id)::INTEGER AS rank FROM documents) WHERE rank <= 5",
)
def k12(spark, sf):
    return op.stratified(a.table(spark, sf, "documents").select("lang", "source", "doc_id"), ["lang", "source"], "doc_id", 5, "gold-1")


@query(
    "a31_confusion", "tp fp fn tn", "precision recall accuracy",
    """WITH d AS (SELECT quality AS g, (regexp_matches(text, '^[A-Z][a-z]') AND n_chars > 300)::INT AS p FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
    c AS (SELECT count(*) FILTER (g = 1 AND p = 1) AS tp, count(*) FILTER (g <> 1 AND p = 1) AS fp, count(*) FILTER (g = 1 AND p <> 1) AS fn, count(*) FILTER (g <> 1 AND p <> 1) AS tn FROM d)
    SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy FROM c""",
)
def a31(spark, sf):
    p = (F.col("text").rlike("^[A-Z][a-z]") & (F.col("n_chars") > 300)).cast("int")
    d = a.table(spark, sf, "documents").join(a.table(spark, sf, "labels"), "doc_id").select(F.col("quality").alias("g"), p.alias("p"))
    return op.confusion(d, "g", "p")


@query("f28_segments", "item_id n chars", "")
def f28(spark, sf):
    b = a.table(spark, sf, "benchmark").withColumn("parts", op.segments(F.col("text"), 80))
    chars = F.aggregate("parts", F.lit(0), lambda acc, x: acc + x["e"] - x["s"]).cast("long")
    return b.select("item_id", F.size("parts").alias("n"), chars.alias("chars"))
