"""A paged source with an ingestion checkpoint: a streaming Python data source whose start is a log of runs.

Each (source, column) of a feed has pages, numbered without gaps from 0. A run asks every column for the pages after its
checkpoint, writes what it got to a folder of its own, and last writes its line of the log: its status and, for each column,
the page reached and whether that was committed. A checkpoint is trusted only if its run is recorded as ok or degraded and
the column as committed; the newest such run counts. So a run that failed, or that ended without its line, is read again,
while a degraded run is read again only in the columns that it did not commit; rows are shown only for runs and columns
that are trusted, so none shows twice.

Logs of the first version have one page for all columns of a source, trusted only from ok runs; it seeds a column that has no
checkpoint of its own.

Scale: the reader's partitions are ranges of pages of one column, read from that column's own folder by the tasks; the driver
handles a line for each source and column.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

LOG = "run long, version int, status string, source string, column string, page long, committed boolean"
#: Statuses of a run that is trusted.
TRUSTED = ("ok", "degraded")
#: Pages that one task reads.
PAGES = 1024


class Span(InputPartition):
    """Pages lo (exclusive) to hi of one column."""

    def __init__(self, source: str, column: str, lo: int, hi: int):
        self.source, self.column, self.lo, self.hi = source, column, lo, hi


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.schema = options["path"], schema
        #: Offsets are pages by "source/column".
        self.start, self.ends = json.loads(options["start"]), json.loads(options["ends"])

    def initialOffset(self) -> dict:
        return self.start

    def latestOffset(self) -> dict:
        return self.ends

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for key, hi in sorted(end.items()):
            source, column = key.split("/", 1)
            for lo in range(start.get(key, -1), hi, PAGES):
                out.append(Span(source, column, lo, min(hi, lo + PAGES)))
        return out

    def read(self, partition: Span):
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyarrow import fs

        kind, path = fs.FileSystem.from_uri(self.path)
        at = f"{path}/source={partition.source}/column={partition.column}"
        wanted = (pc.field("page") > partition.lo) & (pc.field("page") <= partition.hi)
        columns = {f.name: ds.field(f.name) if f.name not in ("source", "column") else ds.scalar(getattr(partition, f.name)) for f in self.schema}
        yield from ds.dataset(at, filesystem=kind, format="parquet").to_batches(columns=columns, filter=wanted)


class Pages(DataSource):
    """format("pages"): options path (a table written by source and column), start and ends (pages by column, as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options, schema)


def write_pages(rows: DataFrame, path: str) -> None:
    """Rows (source, column, page, ...) as the table that a feed serves its pages from."""
    rows.write.partitionBy("source", "column").parquet(path)


def log(spark: SparkSession, base: str) -> DataFrame:
    """The log of runs; empty if there is none yet."""
    try:
        return spark.read.schema(LOG).parquet(f"{base}/log")
    except Exception as e:  # no run has written its line yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG)


def checkpoints(lines: DataFrame, version: int = 2) -> DataFrame:
    """(source, column, page): the trusted checkpoint of each column; a null column is a source's page of the first version."""
    own = lines.where((F.col("version") == version) & F.col("status").isin(*TRUSTED) & F.col("committed") & F.col("page").isNotNull())
    first = lines.where((F.col("version") < version) & (F.col("status") == "ok") & F.col("column").isNull() & F.col("page").isNotNull())
    newest = F.max_by("page", "run").alias("page")
    return own.groupBy("source", "column").agg(newest).unionByName(first.groupBy("source", "column").agg(newest))


def starts(trusted: DataFrame, columns: list[tuple[str, str]]) -> dict[str, int]:
    """Pages by "source/column" that a run goes on from; -1 without a checkpoint."""
    got = {(r["source"], r["column"]): r["page"] for r in trusted.collect()}  # a row a column
    return {f"{s}/{c}": got.get((s, c), got.get((s, None), -1)) for s, c in columns}


def poll(spark: SparkSession, feed: str, schema: str, base: str, run: int, limit: int, outcome: Callable[[str, str], bool] = lambda source, column: True) -> str:
    """One run: every column's next `limit` pages, written under base, and the run's line. outcome says whether a column's pages
    were got whole; with none of them the run has failed, with some it is degraded. Returns the status."""
    spark.dataSource.register(Pages)
    ends = spark.read.parquet(feed).groupBy("source", "column").agg(F.max("page").alias("page")).collect()  # a row a column
    columns = [(r["source"], str(r["column"])) for r in ends]
    start = starts(checkpoints(log(spark, base)), columns)
    goal = {f"{r['source']}/{r['column']}": min(r["page"], start[f"{r['source']}/{r['column']}"] + limit) for r in ends}
    stream = spark.readStream.format("pages").schema(schema).options(path=feed, start=json.dumps(start), ends=json.dumps(goal)).load()
    # a run that is made again after it was lost starts anew: its folder is its own
    out = f"{base}/rows/run={run}"
    at = f"{base}/stream-{run}-{spark.sparkContext.applicationId}"
    write = lambda batch, _: batch.write.mode("overwrite").partitionBy("source", "column").parquet(out)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    done = {key: outcome(*key.split("/", 1)) for key in goal}
    status = "ok" if all(done.values()) else "degraded" if any(done.values()) else "failed"
    lines = [(run, 2, status, *key.split("/", 1), page, done[key]) for key, page in goal.items()]
    spark.createDataFrame(lines, LOG).coalesce(1).write.mode("append").parquet(f"{base}/log")
    return status


def accepted(spark: SparkSession, schema: str, base: str) -> DataFrame:
    """The rows, with their run, of trusted runs and committed columns."""
    ok = log(spark, base).where(F.col("status").isin(*TRUSTED) & F.col("committed")).select("run", "source", "column").distinct()
    rows = spark.read.schema(f"{schema}, run long").parquet(f"{base}/rows")
    return rows.join(F.broadcast(ok), ["run", "source", "column"], "left_semi")  # a row for each run and column
