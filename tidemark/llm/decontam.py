"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts and benchmark items are cut into lower-cased words of letters and digits. A seed looks at a window of WIDTH words
through a fixed mask that ignores some of its positions, so a substituted word under an ignored position does not break
the hit. Seeds of both sides are joined on their hash; each hit names a document, an item and a diagonal (position in
the document less position in the item). Around the hits the words of both sides are compared on the diagonal: an overlap
counts when some SPAN words in a row (the whole item, if it is shorter) agree in at least SHARE of them, substitutions
allowed, and when it does, all agreeing words on the diagonal are counted.

The masks lose nothing that this rule accepts: of any two of thirteen words, or any one of nine, some window and mask
ignores all. Items of ten to twelve words, where the rule allows two substitutions in fewer windows, have four masks of
their own; items of five to eight words, where it allows one, have three masks of their own length, of which one ignores the
substituted position; items under five words, which the rule takes only whole, are looked up whole. Masks for such items are
applied only if the benchmark has any.

Scale. Seeds of a document are made and joined in one pass over the text, without a shuffle: the benchmark's seeds are
broadcast, BROADCAST_SEEDS at most at a time, and a larger benchmark takes a pass for each such part. Only hits leave that
pass, and they are reduced to distinct diagonals before the shuffle; the words of the documents that have hits are cut
again, not carried.

Defined results: null and empty texts, and items without a word, match nothing; repeated documents match alike, one
result row for each pair of document row and item; a null doc_id or item_id is carried as null; empty tables give an empty
result; other columns are ignored (remove keeps them, whatever their names).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table, unused

WORD = "[\\p{L}\\p{N}]+"
WIDTH = 9
#: Positions that the masks look at, for items of nine words and of thirteen or more, and for items of ten to twelve words.
MASKS = ((0, 1, 2, 3, 6, 8), (0, 1, 3, 4, 5, 7), (2, 4, 5, 6, 7, 8))
MID_MASKS = ((0, 2, 5, 7, 8), (0, 1, 2, 6, 8), (0, 3, 4, 5, 8), (2, 3, 4, 6, 7))
SPAN, SHARE = 13, 0.8
#: From so many words on the rule allows a substitution.
SHORT = 5
#: Bounds for broadcasts: seeds of the benchmark (under 100 MB), and documents with hits.
BROADCAST_SEEDS, BROADCAST_HITS = 2_000_000, 500_000


def masks_of(words: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """(number, width, positions) of the masks for items of so many words."""
    if words < SHORT:
        return [(100 + words, words, tuple(range(words)))] if words else []
    if words < WIDTH:  # each ignores a third of the positions
        return [(200 + 10 * words + i, words, tuple(p for p in range(words) if p % 3 != i)) for i in range(3)]
    mid = WIDTH < words < SPAN
    return [(10 * mid + i, WIDTH, m) for i, m in enumerate(MID_MASKS if mid else MASKS)]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def seeds(tokens: Column, masks: list[tuple[int, int, tuple[int, ...]]]) -> Column:
    """array<array<long>>: the seeds of the window at each position, null where a window would pass the end."""
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    empty = F.expr("cast(array() as array<array<bigint>>)")
    least = min(width for _, width, _ in masks)

    def of(h: Column) -> Column:
        def seed(p: Column, number: int, width: int, mask: tuple[int, ...]) -> Column:
            found = F.xxhash64(F.lit(number), *(F.get(h, p + i) for i in mask))
            return found if width == least else F.when(p + width <= F.size(h), found)

        return F.transform(F.sequence(F.lit(0), F.size(h) - least), lambda p: F.array(*(seed(p, *m) for m in masks)))

    # a one-element array holds the hashes, so that they are made once for each row
    return F.when(F.size(tokens) >= least, F.get(F.transform(F.array(hashed), of), F.lit(0))).otherwise(empty)


def exploded(df: DataFrame, key: list[str], name: str, masks: list[tuple[int, int, tuple[int, ...]]]) -> DataFrame:
    """key, position `name`, seed hash h: a row for each seed of df's tokens."""
    each = df.select(*key, F.posexplode(seeds(F.col("tokens"), masks)).alias(name, "hs"))
    return each.select(*key, name, F.explode("hs").alias("h"))


def _key() -> Column:
    """Names a document row: equal rows share it."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string"), F.length("text").cast("string"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, doc_id, item_id, matched, at): the best overlap of each pair of document and item; at is its first word."""
    cut = benchmark.select("item_id", words(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    items = stage_table(cut.withColumn("__item", F.xxhash64("item_id", "tokens")), "items")
    # the lengths below SPAN that occur, twelve at most; longer items share their masks
    lengths = sorted(r["n"] for r in items.select(F.least(F.size("tokens"), F.lit(SPAN)).alias("n")).distinct().collect())
    families = {tuple(masks_of(n)): [m for m in lengths if masks_of(m) == masks_of(n)] for n in lengths}
    texts = docs.select(_key().alias("__key"), "text", "doc_id")
    if not families:
        return texts.limit(0).select("__key", "doc_id", *(F.lit(None).cast(t).alias(n) for n, t in (("item_id", benchmark.schema["item_id"].dataType), ("matched", "int"), ("at", "int"))))
    of = F.least(F.size("tokens"), F.lit(SPAN))
    bench = [exploded(items.where(of.isin(own)), ["__item"], "ip", list(masks)) for masks, own in families.items()]
    bench = stage_table(reduce(DataFrame.union, bench).where("h is not null").distinct(), "seeds")
    parts = max(1, -(-bench.count() // BROADCAST_SEEDS))
    small = parts == 1
    cut = exploded(texts.select("__key", words(F.col("text")).alias("tokens")), ["__key"], "dp", [m for masks in families for m in masks])
    found = [cut.join(F.broadcast(bench.where(F.pmod("h", F.lit(parts)) == i)), "h") for i in range(parts)]
    hits = reduce(DataFrame.union, found).select("__key", "__item", (F.col("dp") - F.col("ip")).alias("diag")).distinct()
    hits = stage_table(hits, "hits")
    keys = hits.select("__key").distinct()
    known = F.broadcast(keys) if keys.count() <= BROADCAST_HITS else keys
    found = texts.join(known, "__key", "left_semi").dropDuplicates(["__key"]).select("__key", "doc_id", words(F.col("text")).alias("tokens"))
    items = items.select("__item", "item_id", F.col("tokens").alias("item")).dropDuplicates(["__item"])
    # the items' words join first: they are short, and a document's words are then shuffled once, not once a diagonal
    both = hits.join(F.broadcast(items) if small else items, "__item").join(found, "__key")
    first, last = F.greatest(F.lit(0), -F.col("diag")), F.least(F.size("item"), F.size("tokens") - F.col("diag")) - 1
    agree = F.transform(F.sequence(first, last), lambda i: F.when(F.get("tokens", i + F.col("diag")) == F.get("item", i), 1).otherwise(0))
    span = F.least(F.lit(SPAN), F.size("item"))
    both = both.withColumn("agree", agree).withColumn("span", span).withColumn("first", first + F.col("diag"))
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(1), F.size("agree") - F.col("span") + 1),
            lambda i: F.aggregate(F.slice("agree", i, F.col("span")), F.lit(0), lambda a, x: a + x),
        )
    )
    matched = F.aggregate("agree", F.lit(0), lambda a, x: a + x)
    kept = both.where(F.size("agree") >= F.col("span")).where(best >= F.ceil(F.col("span") * SHARE)).select("__key", "doc_id", "item_id", matched.alias("matched"), "first")
    return kept.groupBy("__key", "doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max_by("first", F.struct("matched", -F.col("first"))).alias("at"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, at for each document that holds a passage of an item."""
    found = overlaps(docs, benchmark)
    if docs.where("doc_id is null").isEmpty() and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return found.select("doc_id", "item_id", "matched", "at")
    rows = docs.select(_key().alias("__key"))  # repeated rows: a result for each
    return found.join(rows, "__key").select("doc_id", "item_id", "matched", "at")


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns unchanged, that hold no passage of the benchmark."""
    bad = stage_table(overlaps(docs, benchmark).select("__key").distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_HITS else bad
    key = unused(docs, "key")
    return docs.withColumn(key, _key()).join(bad.withColumnRenamed("__key", key), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def _sql_seeds(table: str, key: str, when: str) -> str:
    """The seeds of a table of windows (key, t, p) for all lengths; when is a condition on the item length n."""
    every = {m: n for n in range(1, SPAN + 1) for m in masks_of(n)}
    lengths = {m: [n for n in range(1, SPAN + 1) if m in masks_of(n)] for m in every}

    def seed(number: int, width: int, mask: tuple[int, ...]) -> str:
        words = " || ' ' || ".join(f"t[p + {i + 1}]" for i in mask)
        own = ", ".join(map(str, lengths[number, width, mask]))
        return f"SELECT {key}, p, '{number}:' || {words} AS h FROM {table} WHERE p + {width} <= len(t) AND {when.format(own)}"

    return " UNION ALL ".join(seed(*m) for m in every)


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS t FROM documents),
b AS (SELECT *, least(len(t), {SPAN}) AS n FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS t FROM benchmark) WHERE len(t) > 0),
dw AS (SELECT rid, t, unnest(range(len(t))) AS p FROM d),
bw AS (SELECT item_id, t, n, unnest(range(len(t))) AS p FROM b),
ds AS ({_sql_seeds("dw", "rid", "EXISTS (SELECT 1 FROM b WHERE n IN ({}))")}),
bs AS ({_sql_seeds("bw", "item_id", "n IN ({})")}),
hits AS (SELECT DISTINCT rid, item_id, ds.p - bs.p AS diag FROM ds JOIN bs USING (h)),
al AS (SELECT hits.*, d.doc_id, least({SPAN}, len(b.t)) AS span, greatest(0, -diag) + diag AS first,
              list_transform(range(greatest(0, -diag), least(len(b.t), len(d.t) - diag)), lambda i: (d.t[i + diag + 1] = b.t[i + 1])::INT) AS agree
       FROM hits JOIN d USING (rid) JOIN b USING (item_id)),
ok AS (SELECT rid, doc_id, item_id, first, list_sum(agree) AS matched FROM al
       WHERE len(agree) >= span AND list_max(list_transform(range(1, len(agree) - span + 2), lambda i: list_sum(agree[i:i + span - 1]))) >= ceil(span * {SHARE}))
SELECT doc_id, item_id, max(matched)::INTEGER AS matched, arg_max(first, matched * 1000000000 - first)::INTEGER AS at FROM ok GROUP BY rid, doc_id, item_id"""
