"""Streaming forms: minute aggregates, de-duplication, idempotent sinks, gap sessions (state machines: states).

Each takes a streaming (or batch) frame of ticks. ``drain`` runs one to the end of its input (available-now trigger) with a
checkpoint in the shared folder and returns what it has written, so that a stream can be compared with its batch form.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.functions.shared import shared_dir

#: Files that one micro-batch reads, which bounds its size whatever the backlog.
FILES = 64


def read(spark: SparkSession, path: str, pattern: str, files: int = FILES) -> DataFrame:
    """A table of a folder, one file or a folder of files, as a stream with the schema of what is there now, `files` of them a
    batch. Files may come in any order of time as long as the watermark of what follows allows for it."""
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    options = {"recursiveFileLookup": "true", "maxFilesPerTrigger": str(files)}
    return spark.readStream.schema(schema).options(**options).parquet(f"{path}/{pattern}")


def minute_breadth(ticks: DataFrame, late: str = "90 seconds") -> DataFrame:
    """(minute, event_type, n, total, highest): tumbling minutes, closed by the watermark."""
    marked = ticks.withWatermark("ts", late)
    g = marked.groupBy(F.window("ts", "1 minute"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("highest"))
    return g.select(F.col("window.start").alias("minute"), "event_type", "n", "total", "highest")


def unique_events(ticks: DataFrame, key: str, late: str = "30 minutes") -> DataFrame:
    """Re-read overlaps removed by key, with state bounded by the watermark."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def gap_sessions(ticks: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(symbol, started, ended, n): sessions that end after a gap without events; a session is written when the watermark has
    passed its end, so the last ones wait for later events or for a heartbeat."""
    g = ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "symbol").agg(F.count("*").alias("n"))
    return g.select("symbol", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def with_heartbeats(ticks: DataFrame, path: str) -> DataFrame:
    """ticks and the rows of a folder of heartbeats, which move the watermark on where a feed has gone quiet. Heartbeats have a
    time and nothing else; what is made of them has a null key."""
    spark = ticks.sparkSession
    spark.createDataFrame([], ticks.schema).write.mode("append").parquet(path)
    beats = spark.readStream.schema(ticks.schema).parquet(path)
    return ticks.unionByName(beats)


def beat(spark: SparkSession, schema: StructType, path: str, column: str, at) -> None:
    """Writes a heartbeat of a time."""
    spark.range(1).select(*(F.lit(at if f.name == column else None).cast(f.dataType).alias(f.name) for f in schema)).write.mode("append").parquet(path)


def drain(df: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that its source has now and return what it has written."""
    base = f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    run(df, base, mode, keys)
    return written(df.sparkSession, df.schema, base, mode, keys)


def run(df: DataFrame, base: str, mode: str = "append", keys: list[str] | None = None) -> None:
    """Run a stream once, with its checkpoint and its output under base. With keys, the sink is idempotent: each batch
    overwrites a folder of its own, so a replayed batch replaces itself, and costs no more however many came before."""
    out = f"{base}/out"
    writer = df.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if keys:

        def sink(batch: DataFrame, epoch: int) -> None:
            rows = batch.dropDuplicates(keys)
            rows.withColumn("__epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

        query = writer.foreachBatch(sink).outputMode("append" if mode == "append" else "update").start()
    else:
        query = writer.outputMode(mode).format("parquet").option("path", out).start()
    query.awaitTermination()


def written(spark: SparkSession, schema: StructType, base: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """The rows that runs under base have written. With keys one row of each: that of the first batch that had it in append
    mode, that of the last one in update mode."""
    out = f"{base}/out"
    if not keys:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    got = spark.read.schema(StructType([*schema.fields, StructField("__epoch", LongType())])).option("recursiveFileLookup", "true").parquet(out)
    order = F.col("__epoch") if mode == "append" else F.desc("__epoch")
    one = got.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__rank = 1")
    return one.drop("__epoch", "__rank")


def slot_clusters(slots: DataFrame, runs: DataFrame, tolerance: int) -> tuple[DataFrame, DataFrame]:
    """Slots (job, at, cluster, n, lo) and the runs near them, alike: a job's slots are cut where the next is more than twice
    the tolerance away, so that no run is near two clusters; n and lo are a cluster's number of slots and its first."""
    w = Window.partitionBy("job").orderBy("at")
    new = F.coalesce((F.col("at") - F.lag("at").over(w) > 2 * tolerance).cast("long"), F.lit(0))
    marked = slots.select("job", "at").withColumn("new", new).withColumn("cluster", F.sum("new").over(w)).drop("new")
    spans = marked.groupBy("job", "cluster").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    width = 2 * tolerance + 1
    buckets = F.sequence(F.floor((F.col("lo") - tolerance) / width), F.floor((F.col("hi") + tolerance) / width))
    s = spans.withColumn("bucket", F.explode(buckets)).withColumnRenamed("job", "of")
    r = runs.select("job", "at").withColumn("bucket", F.floor(F.col("at") / width))
    meets = F.col("job").eqNullSafe(F.col("of")) & (r.bucket == s.bucket) & F.col("at").between(F.col("lo") - tolerance, F.col("hi") + tolerance)
    near = r.join(s, meets).select("job", "at", "cluster", "n", "lo")
    each = spans.select(F.col("job").alias("of"), F.col("cluster").alias("c"), "n", "lo")
    owned = marked.join(each, F.col("job").eqNullSafe(F.col("of")) & (F.col("cluster") == F.col("c")))
    return owned.select("job", "at", "cluster", "n", "lo"), near


def slot_matches(slots: DataFrame, runs: DataFrame, tolerance: int) -> DataFrame:
    """Greedy one-to-one matching of expected slots and runs (job, at) within a tolerance in seconds: pairs in the order of
    distance, slot, run; each slot and run is used once. A slot without another near it takes its nearest run, by an
    aggregate; one group is one cluster of slots that can compete for a run."""

    def match(s: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        job = (s if len(s) else r)["job"].iloc[0]
        a, b = sorted(s["at"].astype("int64")), sorted(r["at"].astype("int64"))
        pairs, lo = [], 0
        for i, x in enumerate(a):
            while lo < len(b) and b[lo] < x - tolerance:
                lo += 1
            j = lo
            while j < len(b) and b[j] <= x + tolerance:
                pairs.append((abs(b[j] - x), x, b[j], i, j))
                j += 1
        used_a, used_b, out = set(), set(), {}
        for _, x, y, i, j in sorted(pairs):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                out[i] = y
        return pd.DataFrame({"job": job, "slot": a, "run": pd.array([out.get(i) for i in range(len(a))], dtype="Int64")})

    owned, near = slot_clusters(slots, runs, tolerance)
    far = F.struct(F.abs(F.col("at") - F.col("lo")), "at")
    best = near.where("n = 1").groupBy(F.col("job").alias("of"), F.col("cluster").alias("c")).agg(F.min_by("at", far).alias("run"))
    alone = owned.where("n = 1").join(best, F.col("job").eqNullSafe(F.col("of")) & (F.col("cluster") == F.col("c")), "left")
    left = owned.where("n > 1").select("job", "at", "cluster")
    right = near.where("n > 1").select(F.col("job").alias("job"), "at", F.col("cluster").alias("c"))  # names of its own, for the cogroup
    rivals = left.groupBy("job", "cluster").cogroup(right.groupBy("job", "c")).applyInPandas(match, "job string, slot long, run long")
    return alone.select("job", F.col("at").alias("slot"), "run").union(rivals)
