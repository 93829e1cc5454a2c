"""News text: normalisation, canonical URLs, de-duplication, symbol mentions, classification, sampling, evaluation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: query parameters that only track
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "from", "ref")


def nfkc(text: Column) -> Column:
    """Unicode NFKC, for which there is no built-in function: an Arrow-batched UDF."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(run, "string")(text)


def normalise(text: Column, compatibility: bool = False) -> Column:
    """Runs of white space become one space; optionally NFKC first."""
    return F.trim(F.regexp_replace(nfkc(text) if compatibility else text, "\\s+", " "))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, repeated slashes collapsed, tracking parameters dropped, the rest sorted."""
    bare = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z]+://([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z]+://[^/?]*([^?]*)", 1), "/{2,}", "/")
    q = F.regexp_extract(bare, "[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(q, "&"), lambda p: (p != "") & ~F.element_at(F.split(p, "="), 1).isin(*TRACKING)))
    return F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def content_hash(*cols: Column) -> Column:
    """SHA-256 over the columns, unit-separated; null counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("")) for c in cols)), 256)


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in arrival order: only the order columns and a row are compared, in a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, "__r.*").select(*df.columns)


def dedupe_news(news: DataFrame, order: list[str]) -> DataFrame:
    """By url, then by content hash; the first arrival stays."""
    return first_per(first_per(news, ["url"], order), ["content_hash"], order)


def classify(title: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """The first rule, in order, of which a keyword occurs; else 'other'."""
    out = None
    for name, words in rules.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(title, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def unique_mention(texts: DataFrame, universe: DataFrame) -> DataFrame:
    """texts (id, text) with symbol: the one six-digit code of the universe in the text; null for none or several."""
    codes = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?<![0-9])([0-9]{6})(?![0-9])"), F.lit(1)))).alias("symbol"))
    one = codes.join(universe.select("symbol").distinct(), "symbol").groupBy("id").agg(F.count("*").alias("n"), F.min("symbol").alias("symbol")).where("n = 1")
    return texts.join(one.select("id", "symbol"), "id", "left")


def fact_tokens(text: Column) -> Column:
    """Sorted multiset of number tokens: two texts state the same figures only if these are equal."""
    return F.array_sort(F.regexp_extract_all(text, F.lit("[0-9]+(?:[.][0-9]+)?%?"), F.lit(0)))


def segments(text: Column, size: int) -> Column:
    """array<struct<i, s, e>>: an exact partition of a text into spans of at most `size` code points, cut after the last
    sentence mark of a span's second half if there is one. Linear in the text; empty for empty texts."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s: int, e: int>>)").alias("out"))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(text) * 2 / size).cast("int") + 1))

    def step(acc, _):
        window = F.substring(text, acc["at"] + 1, F.lit(size))
        cut = F.length(F.regexp_extract(window, f"(?s)^(.{{{size // 2},}}[.!?\\n])", 1))
        n = F.when(acc["at"] + size >= F.length(text), F.length(text) - acc["at"]).when(cut > 0, cut).otherwise(F.lit(size))
        done = acc["at"] >= F.length(text)
        return F.struct(
            F.when(done, acc["at"]).otherwise(acc["at"] + n).alias("at"),
            F.when(done, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), (acc["at"] + n).alias("e"))))).alias("out"),
        )

    return F.aggregate(steps, start, step)["out"]


def stratified(df: DataFrame, strata: list[str], key: str, quota: int, seed: str) -> DataFrame:
    """Exactly `quota` rows of each stratum (all, if fewer) in the order of SHA-256 of seed and key."""
    w = Window.partitionBy(*strata).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quota)


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: counts of the four outcomes, precision, recall, accuracy; ratios without a base are null."""
    g, p = F.col(gold) == 1, F.col(predicted) == 1
    c = df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()).agg(
        F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn")
    )

    def ratio(a, b):
        return F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)).cast("double"))

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})
