"""Tables and lists in raw pages, read with built-in functions.

Pages are cut at their tags by patterns of one repeated class each, which take no deep stack however long a page is; unclosed
rows, cells and items end where the next one starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import finite

#: What is no content: scripts, styles and comments.
NOISE = "(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->"
# fixed values: the named entities that are resolved, the ampersand last
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain(html: Column) -> Column:
    """The text of a piece of a page: without tags, entities resolved, white space joined."""
    out = F.regexp_replace(html, "<[^>]*>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, "[\\s\\u00a0]+", " "))


def pieces(html: Column, tag: str) -> Column:
    """What stands behind each opening tag up to the next one, or its closing tag: tag is a pattern of tag names."""
    cut = F.split(html, f"(?i)<(?:{tag})(?=[\\s>])[^>]*>", -1)
    return F.transform(F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0))), lambda x: F.get(F.split(x, f"(?i)</(?:{tag})\\s*>", 2), F.lit(0)))


def links(pages: DataFrame, inside: str = "li") -> DataFrame:
    """(page_id, pos, href, title) of the first link of each list item, in order from 1; items without one are skipped. A page
    without a text has none."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), NOISE, " ")
    each = pages.select("page_id", F.posexplode(pieces(body, inside)).alias("i", "item"))
    href = F.regexp_extract("item", "(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"']([^\"']*)[\"'][^>]*>", 1)
    title = F.get(pieces(F.col("item"), "a"), F.lit(0))
    found = each.select("page_id", "i", href.alias("href"), plain(title).alias("title")).where("href <> '' AND title <> ''")
    w = Window.partitionBy("page_id").orderBy("i")  # the items of a page
    return found.select("page_id", F.row_number().over(w).cast("long").alias("pos"), "href", "title")


def table_rows(pages: DataFrame, required: list[str]) -> DataFrame:
    """(page_id, row, cells map<string, string>) of the first table of each page that has all required columns in its first row
    and at least one row more. Rows that are shorter have nulls; pages without such a table have no rows."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), NOISE, " ")
    rows = lambda t: F.transform(pieces(t, "tr"), lambda r: F.transform(pieces(r, "td|th"), plain))
    tables = pages.select("page_id", F.posexplode(F.transform(pieces(body, "table"), rows)).alias("t", "rows"))
    head = F.get("rows", F.lit(0))
    fits = tables.where((F.size("rows") > 1) & (F.size(F.array_except(F.array(*map(F.lit, required)), head)) == 0))
    first = fits.groupBy("page_id").agg(F.min_by("rows", "t").alias("rows"))
    each = first.select("page_id", F.get("rows", F.lit(0)).alias("head"), F.posexplode(F.slice("rows", F.lit(2), F.size("rows"))).alias("row", "cells"))
    named = F.map_from_arrays(F.array(*map(F.lit, required)), F.array(*(F.get("cells", (F.array_position("head", c) - 1).cast("int")) for c in required)))
    return each.select("page_id", (F.col("row") + 1).alias("row"), named.alias("cells"))


def parity(rows: DataFrame, day: str, value: str, scale: float = 100.0) -> DataFrame:
    """(page_id, as_of, value, change_pct): the newest point of each page and its change against the one before; rows without a
    day, or without a positive number, are skipped. Of a repeated day the last row counts as the newer."""
    d = rows.select("page_id", "row", F.col("cells")[day].try_cast("date").alias("day"), (finite(F.col("cells")[value]) / scale).alias("v")).where("day IS NOT NULL AND v > 0")
    w = Window.partitionBy("page_id").orderBy(F.desc("day"), F.desc("row"))
    d = d.withColumn("n", F.row_number().over(w)).withColumn("before", F.lead("v").over(w)).where("n = 1")
    return d.select("page_id", F.col("day").alias("as_of"), F.round("v", 4).alias("value"), F.round((F.col("v") / F.col("before") - 1) * 100, 4).alias("change_pct"))
