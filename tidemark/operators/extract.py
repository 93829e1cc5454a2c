"""Events from disclosures: a model's answers in JSON are checked, refused ones are kept apart, rules stand in for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: subtypes of an event, and the keywords of the rules
SUBTYPES = ("earnings", "dividend", "holder_change", "regulation", "contract", "buyback", "personnel", "other")
POSITIVE = (("预增", "earnings"), ("中标", "contract"), ("回购", "buyback"), ("分红", "dividend"))
NEGATIVE = (("预减", "earnings"), ("问询", "regulation"), ("处罚", "regulation"), ("减持", "holder_change"))
HAN = "[\\u3400-\\u9fff]"

FIELDS = {"event_type": "string", "direction": "double", "strength": "double", "horizon_days": "int", "summary": "string", "source_quote": "string"}
REQUIRED = [k for k in FIELDS if k != "horizon_days"]
#: From this strength on an event is worth a notice.
NOTICE = 0.6


def answers(disclosures: DataFrame) -> DataFrame:
    """disclosures (id, title, answer, ...) with a, the parsed answer, and refusal: the first rule that it breaks, else null. A
    text that is no JSON object, or has a value of another type, is malformed; the others are named by their field."""
    schema = ", ".join(f"{k} {t}" for k, t in FIELDS.items()) + ", __bad string"
    parsed = F.from_json("answer", schema, {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"})
    d = disclosures.withColumn("a", parsed).withColumn("__keys", F.json_object_keys("answer"))
    has = lambda k: F.array_contains("__keys", k)
    length = lambda k, most: F.length(F.col(f"a.{k}")).between(1, most)
    missing = F.lit(False)
    for k in REQUIRED:
        missing = missing | ~has(k) | F.col(f"a.{k}").isNull()
    refusal = (
        F.when(F.col("a").isNull() | F.col("a.__bad").isNotNull() | F.col("__keys").isNull(), "malformed")
        .when(F.size(F.array_except("__keys", F.array(*map(F.lit, FIELDS)))) > 0, "additional")
        .when(missing, "missing")
        .when(~F.col("a.event_type").isin(*SUBTYPES), "event_type")
        .when(~F.col("a.direction").between(-1, 1), "direction")
        .when(~F.col("a.strength").between(0, 1), "strength")
        .when(has("horizon_days") & ~F.coalesce(F.col("a.horizon_days").between(1, 250), F.lit(False)), "horizon")
        .when(~length("summary", 120) | (F.trim("a.summary") == "") | ~F.col("a.summary").rlike(HAN), "summary")
        .when(~length("source_quote", 200) | (F.trim("a.source_quote") == ""), "quote")
        .when(~F.coalesce(F.col("title").contains(F.col("a.source_quote")), F.lit(False)), "quote_absent")
    )
    return d.withColumn("refusal", F.when(F.col("answer").isNull(), "unavailable").otherwise(refusal)).drop("__keys")


def by_rule(title: Column) -> Column:
    """Struct of what the keywords say of a title: the first that occurs, good ones before bad ones, else `other`."""
    made = lambda kind, direction, quote: F.struct(F.lit(kind).alias("subtype"), F.lit(direction).alias("direction"), F.lit(0.5).alias("strength"), quote.alias("quote"))
    out = made("other", 0.0, F.substring(F.coalesce(title, F.lit("")), 1, 200))
    for words, direction in ((NEGATIVE, -0.5), (POSITIVE, 0.5)):
        for word, kind in reversed(words):
            out = F.when(title.contains(word), made(kind, direction, F.lit(word))).otherwise(out)
    return out


def classify(disclosures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row a disclosure, the quarantine). Rows have subtype, direction, strength, quote and origin (model or rule); the
    quarantine has the answers that were refused, with the reason."""
    d = answers(disclosures)
    model = F.struct(F.col("a.event_type").alias("subtype"), F.col("a.direction").alias("direction"), F.col("a.strength").alias("strength"), F.col("a.source_quote").alias("quote"))
    best = F.when(F.col("refusal").isNull(), model).otherwise(by_rule(F.col("title")))
    own = [c for c in disclosures.columns if c != "answer"]
    rows = d.select(*own, best.alias("__b"), F.when(F.col("refusal").isNull(), "model").otherwise("rule").alias("origin")).select(*own, "__b.*", "origin")
    return rows, d.where("refusal IS NOT NULL AND refusal <> 'unavailable'").select("id", "answer", "refusal")


def persist(events: DataFrame, classified: DataFrame) -> DataFrame:
    """The table of events (source_ref, subtype, direction, strength, at, notice) after classified (id, at, ...): one event a
    disclosure, that of its newest row, in the place of the one before. notice marks those that are new or whose strength
    has risen to NOTICE; events that were there and are not classified again have none."""
    w = Window.partitionBy("source_ref").orderBy(F.desc_nulls_last("at"), F.desc("strength"), "subtype", "direction")
    fresh = classified.where(F.col("id").isNotNull()).withColumn("source_ref", F.concat(F.lit("disclosure:"), F.col("id").cast("string")))
    fresh = fresh.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("source_ref", "subtype", "direction", "strength", "at")
    had = events.select("source_ref", F.col("strength").alias("__before"))
    marked = fresh.join(had, "source_ref", "left").withColumn("notice", F.col("__before").isNull() | ((F.col("__before") < NOTICE) & (F.col("strength") >= NOTICE))).drop("__before")
    kept = events.select("source_ref", "subtype", "direction", "strength", "at").join(fresh.select("source_ref"), "source_ref", "left_anti").withColumn("notice", F.lit(False))
    return marked.unionByName(kept)
