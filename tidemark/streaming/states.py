"""Keyed states of a stream whose files come in any order: state machines, and states with compare-and-set.

Each micro-batch is joined by the rows that were still waiting; those that the watermark has passed are due and are decided in
the order of their references, the others wait on. States, waiting rows and the clock are tables of the batch (an epoch) in
the shared folder: a batch reads those of the one before it, so one that is made again gives the same. A key of very many rows
is sorted and read row by row; no frame holds a key.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.shared import discard

STATE = "symbol string, name string, ref string, version long"
#: decide(due rows, states) gives the rows to write, and the states of the keys that changed.
Decide = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def transitions(due: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbol, before, after, ref) of each change of state of due (symbol, state, ref). A row that repeats the state, or is not
    behind the last one decided, changes nothing, so replays are harmless."""
    had = states.select("symbol", F.col("name").alias("__name"), F.col("ref").alias("__ref"), F.col("version").alias("__version"))
    rows = due.join(had, "symbol", "left").where(F.col("__ref").isNull() | (F.col("ref") > F.col("__ref"))).dropDuplicates(["symbol", "ref"])
    w = Window.partitionBy("symbol").orderBy("ref")
    rows = rows.withColumn("before", F.when(F.row_number().over(w) == 1, F.col("__name")).otherwise(F.lag("state").over(w)))
    changed = rows.where(~F.col("state").eqNullSafe(F.col("before")))
    out = changed.select("symbol", "before", F.col("state").alias("after"), "ref")
    # the last reference counts whether or not it was a change
    last = rows.groupBy("symbol").agg(
        F.max_by("state", "ref").alias("name"), F.max("ref").alias("ref"), (F.coalesce(F.max("__version"), F.lit(0)) + F.count_if(~F.col("state").eqNullSafe(F.col("before")))).alias("version")
    )
    return out, last


DECISION = "symbol string, ref string, writer string, expected string, before string, after string, version long, status string"


def compare_and_set(due: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A decision for each proposal (symbol, ref, writer, expected, state), in the order of (ref, writer) of its symbol: accepted
    if the state is the expected one then (none for a new symbol), and the version goes up; unchanged if it is the proposed one
    already; else stale, and nothing changes. before and version are those after the decision's predecessors."""
    had = states.select("symbol", F.col("name").alias("__name"), F.col("version").alias("__version"))
    rows = due.select("symbol", "ref", "writer", "expected", "state").join(had, "symbol", "left")
    rows = rows.repartition("symbol").sortWithinPartitions("symbol", "ref", "writer", "expected", "state")

    def run(batches):
        key, name, version, first = None, None, 0, True
        for b in batches:
            out = []
            for symbol, ref, writer, expected, state, had_name, had_version in zip(*(c.to_pylist() for c in b.columns)):
                if first or symbol != key:
                    key, name, version, first = symbol, had_name, had_version or 0, False
                before = name
                if state == name:
                    status = "unchanged"
                elif expected != name:
                    status = "stale"
                else:
                    status, name, version = "accepted", state, version + 1
                out.append((symbol, ref, writer, expected, before, state, version, status))
            columns = list(zip(*out)) or [()] * 8
            kinds = [pa.string()] * 6 + [pa.int64(), pa.string()]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in DECISION.split(", ")])

    decided = rows.mapInArrow(run, DECISION)
    own = decided.where("status = 'accepted'").groupBy("symbol").agg(F.max_by("after", "version").alias("name"), F.max_by("ref", "version").alias("ref"), F.max("version").alias("version"))
    return decided, own


def run(events: DataFrame, base: str, decide: Decide, late: str, time: str = "ts") -> None:
    """Runs a stream of rows (symbol, ref, `time`, ...) to the end of its input, with its checkpoint and tables under base. Rows
    wait until the newest time seen is `late` beyond theirs. Rows without a symbol are heartbeats: they only move that time."""
    query = events.writeStream.foreachBatch(_sink(base, decide, late, time)).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def _sink(base: str, decide: Decide, late: str, time: str):
    def at(name: str, epoch: int) -> str:
        return f"{base}/{name}/epoch={epoch}"

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        waiting = _table(spark, at("waiting", epoch - 1), batch.schema, epoch)
        states = _table(spark, at("states", epoch - 1), STATE, epoch)
        clock = _table(spark, at("clock", epoch - 1), f"at {batch.schema[time].dataType.simpleString()}", epoch)
        now = batch.agg(F.max(time).alias("at")).union(clock).agg(F.max("at").alias("at"))
        now.coalesce(1).write.mode("overwrite").parquet(at("clock", epoch))
        now = spark.read.parquet(at("clock", epoch)).select((F.col("at") - F.expr(f"interval {late}")).alias("__now"))
        rows = batch.where("symbol IS NOT NULL").unionByName(waiting).crossJoin(F.broadcast(now))  # one row
        is_due = F.coalesce(F.col(time) <= F.col("__now"), F.col(time).isNull())
        rows.where(~is_due).drop("__now").write.mode("overwrite").parquet(at("waiting", epoch))
        out, changed = decide(rows.where(is_due).drop("__now", time), states)
        out.write.mode("overwrite").parquet(at("out", epoch))
        kept = states.join(changed.select("symbol"), "symbol", "left_anti")
        kept.unionByName(changed.select("symbol", "name", "ref", "version")).write.mode("overwrite").parquet(at("states", epoch))
        if epoch > 1:  # only the epoch before the next one can be needed again
            for name in ("waiting", "states", "clock"):
                discard(spark, at(name, epoch - 2))

    return sink


def _table(spark: SparkSession, path: str, schema: str | StructType, epoch: int) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if epoch else spark.createDataFrame([], schema)


def written(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """All rows that runs under base have decided."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")
