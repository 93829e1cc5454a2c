"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Without that setting a local session gets a temporary folder of its
    own; a cluster gets an error, as a machine's own folder would lose what other machines write."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL[app]


def stage(df: DataFrame, name: str) -> str:
    """The path of df, written as Parquet in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """A scan of df as written in the shared folder: cuts the lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(stage(df, name))


def version(spark: SparkSession, path: str) -> tuple:
    """What tells a table's files from those of before: length, number and time of the last change."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    all_, own = fs.getContentSummary(at), fs.getFileStatus(at)
    return all_.getLength(), all_.getFileCount(), own.getModificationTime()


def discard(spark: SparkSession, path: str) -> None:
    """Removes a staged table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
