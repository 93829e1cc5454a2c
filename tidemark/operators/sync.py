"""Tables that are kept in step: incremental requests, snapshots with manifests, repairs of touched partitions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.shared import discard
from tidemark.sources.merge import pick, upsert_changed

# ---------------------------------------------------------------- incremental factors


def request_windows(bars: DataFrame, known: DataFrame, start: str | None = None, refresh: bool = False) -> DataFrame:
    """(symbol, part, lo, hi, known_source): what to ask a provider for, per symbol the days before its first known factor (head),
    those after its last (tail), or all of its bars; with refresh also the last day of symbols that are up to date. Symbols
    with nothing missing have no row."""
    first = F.min("session") if start is None else F.greatest(F.min("session"), F.lit(start).cast("date"))
    spans = bars.groupBy("symbol").agg(first.alias("first"), F.max("session").alias("last"))
    have = known.groupBy("symbol").agg(F.min("session").alias("__lo"), F.max("session").alias("__hi"), F.max_by("source", F.struct("session", "source")).alias("known_source"))
    d = spans.join(have, "symbol", "left")
    head = F.when(F.col("__lo") > F.col("first"), F.struct(F.lit("head").alias("part"), F.col("first").alias("lo"), F.date_sub("__lo", 1).alias("hi")))
    tail = (
        F.when(F.col("__hi").isNull(), F.struct(F.lit("all").alias("part"), F.col("first").alias("lo"), F.col("last").alias("hi")))
        .when(F.col("__hi") < F.col("last"), F.struct(F.lit("tail").alias("part"), F.date_add("__hi", 1).alias("lo"), F.col("last").alias("hi")))
        .when(F.lit(refresh) & (F.col("__hi") == F.col("last")), F.struct(F.lit("refresh").alias("part"), F.col("__hi").alias("lo"), F.col("last").alias("hi")))
    )
    each = d.select("symbol", "known_source", F.explode(F.filter(F.array(head, tail), lambda x: x.isNotNull())).alias("w"))
    return each.select("symbol", "w.part", "w.lo", "w.hi", "known_source").where("lo <= hi")


def sync_factors(bars: DataFrame, known: DataFrame, offered: DataFrame, start: str | None = None, refresh: bool = False, tolerance: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """(the merged table, a report by symbol). offered (symbol, session, adj_factor, source) is what providers have; only the
    requested windows of it are used. A symbol whose rows come from another source than the one it has, or from several, or
    that gets none, fails as a whole and keeps what it has. report is (symbol, status, requested, received, covered)."""
    asked = request_windows(bars, known, start, refresh)
    got = offered.join(asked, "symbol").where(F.col("session").between(F.col("lo"), F.col("hi")))
    got = got.select("symbol", "session", "adj_factor", "source", "known_source")
    per = got.groupBy("symbol").agg(F.count("*").alias("received"), F.countDistinct("source").alias("__n"), F.min("source").alias("__s"))
    want = asked.groupBy("symbol").agg(F.count("*").alias("requested"), F.max("known_source").alias("known_source"))
    d = bars.select("symbol").distinct().join(want, "symbol", "left").join(per, "symbol", "left")
    status = (
        F.when(F.col("requested").isNull(), "skipped")
        .when(F.coalesce("received", F.lit(0)) == 0, "no_data")
        .when((F.col("__n") > 1) | (F.col("__s") != F.coalesce("known_source", F.col("__s"))), "source_changed")
        .otherwise("synced")
    )
    d = d.select("symbol", status.alias("status"), F.coalesce("requested", F.lit(0)).alias("requested"), F.coalesce("received", F.lit(0)).alias("received"))
    fresh = got.join(d.where("status = 'synced'").select("symbol"), "symbol", "left_semi").select("symbol", "session", "adj_factor", "source")
    fresh = pick(fresh, ["symbol", "session"], F.col("adj_factor").asc_nulls_last())
    merged = upsert_changed(known.select("symbol", "session", "adj_factor", "source"), fresh, ["symbol", "session"], "adj_factor", tolerance)
    covered = known.select("symbol").union(fresh.select("symbol")).distinct().withColumn("covered", F.lit(True))
    return merged, d.join(covered, "symbol", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


# ---------------------------------------------------------------- snapshots


def row_digest(columns: list[str]) -> Column:
    """48 bits of an MD5 of a row, as a decimal: sums of them don't depend on the order of rows."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(20,0)")


def manifest(df: DataFrame, by: str) -> DataFrame:
    """(part, n, digest) of each partition: one row a partition, summed before the shuffle."""
    columns = sorted(c for c in df.columns if c != by)
    return df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("~")).alias("part")).agg(F.count("*").alias("n"), (F.sum(row_digest(columns)) % F.lit(2**60)).cast("long").alias("digest"))


def export_snapshot(df: DataFrame, path: str, by: str) -> DataFrame:
    """Writes df as Parquet by partition, then its manifest, made from what was written. The manifest comes last: a folder
    without one is no snapshot."""
    spark = df.sparkSession
    df.write.partitionBy(by).parquet(f"{path}/rows")
    written = _read_rows(spark, path, df)
    manifest(written, by).coalesce(1).write.option("compression", "none").parquet(f"{path}/manifest")
    spark.createDataFrame([(json.dumps({"by": by, "schema": df.schema.jsonValue()}),)], "value string").coalesce(1).write.text(f"{path}/about")
    return spark.read.parquet(f"{path}/manifest")


def _read_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(f"{path}/rows").select(*like.columns)


class SnapshotError(ValueError):
    """A snapshot that must not be used, or that contradicts the target."""


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a snapshot whose partitions all agree with its manifest. A missing, added or damaged one is an error."""
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    schema = StructType.fromJson(about["schema"])
    rows = spark.read.schema(schema).parquet(f"{path}/rows").select(*schema.names)
    said = spark.read.parquet(f"{path}/manifest").select("part", F.col("n").alias("__n"), F.col("digest").alias("__d"))
    j = manifest(rows, about["by"]).join(said, "part", "full")
    bad = j.where(~(F.col("n").eqNullSafe(F.col("__n")) & F.col("digest").eqNullSafe(F.col("__d")))).select("part").orderBy("part").limit(5).collect()
    if bad:
        raise SnapshotError(f"partitions that differ from the manifest: {', '.join(r['part'] for r in bad)}")
    return rows


def import_plan(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(part of the comparison, n): rows that are new, the same, or in conflict with the target's row of the key."""
    columns = [c for c in rows.columns if c not in keys]
    mine = target.select(*keys, F.struct(*columns).alias("__mine"))
    j = rows.select(*keys, F.struct(*columns).alias("__theirs")).join(mine, keys, "left")
    kind = F.when(F.col("__mine").isNull(), "new").when(F.col("__mine").eqNullSafe(F.col("__theirs")), "same").otherwise("conflict")
    return j.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def import_snapshot(target: DataFrame, path: str, keys: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """(the target with the snapshot's new rows, counts of new and same rows). The manifest is checked first, and one row in
    conflict refuses the whole import; a second import adds nothing. Keys must not be null."""
    rows = read_snapshot(target.sparkSession, path)
    counts = {r["kind"]: r["n"] for r in import_plan(target, rows, keys).collect()}  # three rows
    if counts.get("conflict"):
        raise SnapshotError(f"{counts['conflict']} rows contradict the target")
    fresh = rows.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns)), {"new": counts.get("new", 0), "same": counts.get("same", 0)}


# ---------------------------------------------------------------- repairs


def faults(bars: DataFrame) -> DataFrame:
    """bars with a column fault: the first rule that a row breaks (mock source, weekend, impossible prices), else null."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    finite = [p.isNotNull() & ~F.isnan(p) & (p > 0) for p in prices]
    ok = finite[0] & finite[1] & finite[2] & finite[3] & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high"))
    return bars.withColumn("fault", F.when(F.col("source") == "mock", "mock").when(F.dayofweek("session").isin(1, 7), "weekend").when(~ok, "invalid"))


def orphans(factors: DataFrame, bars: DataFrame) -> DataFrame:
    """factors with a column fault: `orphan` for those whose symbol and session have no bar."""
    have = bars.select("symbol", "session").distinct().withColumn("__bar", F.lit(True))
    d = factors.join(have, ["symbol", "session"], "left")
    return d.withColumn("fault", F.when(F.col("__bar").isNull(), "orphan")).drop("__bar")


def repair_partitions(marked: DataFrame, path: str, quarantine: str, by: str, fetched: DataFrame | None = None, keys: tuple[str, ...] = ("symbol", "session")) -> DataFrame:
    """Rewrites the partitions of the table at path that have a row with a fault, and no others. Rows with a fault go to the
    quarantine, with their fault, before anything is changed; an `invalid` one is replaced by its row of fetched, if that is
    there and itself without a fault (values are never made up). marked is the table with a column fault. Returns (by, before,
    removed, repaired, after) of the touched partitions; a clean table returns none and is not written."""
    spark = marked.sparkSession
    own = [c for c in marked.columns if c != "fault"]
    touched = marked.where("fault IS NOT NULL").select(by).distinct()
    rows = marked.join(F.broadcast(touched), by, "left_semi")  # names of partitions, as many as folders
    bad = rows.where("fault IS NOT NULL")
    bad.write.mode("append").parquet(quarantine)
    before = rows.groupBy(by).agg(F.count("*").alias("before"), F.count("fault").alias("removed"))
    kept = rows.where("fault IS NULL").select(*own)
    mended = kept.limit(0)
    if fetched is not None:
        good = faults(fetched).where("fault IS NULL").select(*own)
        mended = good.join(bad.where("fault = 'invalid'").select(*keys).distinct(), list(keys), "left_semi").select(*own)
        mended = pick(mended, list(keys), *(F.col(c).asc_nulls_last() for c in own if c not in keys))
    # the new files are made from a copy: a table cannot be read and overwritten in one job
    copy = f"{path}.rewrite"
    both = kept.withColumn("__mended", F.lit(0)).unionByName(mended.withColumn("__mended", F.lit(1)))
    both.write.mode("overwrite").partitionBy(by).parquet(copy)
    back = spark.read.schema(both.schema).parquet(copy)
    after = back.groupBy(by).agg(F.sum("__mended").alias("repaired"), F.count("*").alias("after"))
    report = before.join(after, by, "left").fillna(0, ["repaired", "after"])
    report = spark.createDataFrame(report.collect(), report.schema)  # a row for each touched partition
    back.select(*own).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    empty = [r[by] for r in report.where("after = 0").collect()]
    for value in empty:  # dynamic overwrite leaves partitions without new rows as they are
        discard(spark, f"{path}/{by}={value}")
    discard(spark, copy)
    return report
