"""Merges into tables without a transaction log: each returns the table after the merge, to be written as its next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import AUDITED


def _both(target: DataFrame, new: DataFrame) -> DataFrame:
    return target.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))


def pick(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first by the order. One shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def insert_or_repair(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert what is absent; replace rows whose source is not audited; keep the others. Applying it twice changes nothing."""
    keep = F.when((F.col("__new") == 0) & F.col("source").isin(*AUDITED), 0).when(F.col("__new") == 1, 1).otherwise(2)
    return pick(_both(target, new), keys, keep).drop("__new")


def upsert_changed(target: DataFrame, new: DataFrame, keys: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Insert what is absent; take the new row only if the value moved by more than the tolerance."""
    w = Window.partitionBy(*keys)
    d = _both(target, new).withColumn("__old", F.max(F.when(F.col("__new") == 0, F.col(value))).over(w))
    moved = F.col("__old").isNull() | (F.abs(F.col(value) - F.col("__old")) > tolerance)
    return pick(d, keys, F.when((F.col("__new") == 1) & moved, 0).when(F.col("__new") == 0, 1).otherwise(2)).drop("__new", "__old")


def insert_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """On conflict do nothing; the first of repeated new rows by their whole content."""
    fresh = new.join(target.select(*keys).distinct(), keys, "left_anti")
    return target.unionByName(pick(fresh, keys, *(F.col(c).asc_nulls_last() for c in new.columns if c not in keys)) if len(new.columns) > len(keys) else fresh.distinct())


def keep_earliest(target: DataFrame, new: DataFrame, keys: list[str], available: str) -> DataFrame:
    """The new payload, with the earliest availability of all rows of the key."""
    w = Window.partitionBy(*keys)
    d = _both(target, new).withColumn(available, F.min(available).over(w))
    return pick(d, keys, F.desc("__new")).drop("__new")


def by_priority(target: DataFrame, new: DataFrame, keys: list[str], *priority: Column) -> DataFrame:
    """The row of each key that the priority puts first; between equals the old one."""
    return pick(_both(target, new), keys, *priority, F.col("__new")).drop("__new")


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def migration_check(old: DataFrame, new: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: keys of one side only and values that differ by more than the relative tolerance."""
    j = old.select(*keys, F.col(value).alias("__a"), F.lit(1).alias("__l")).join(new.select(*keys, F.col(value).alias("__b"), F.lit(1).alias("__r")), keys, "full")
    off = F.abs(F.col("__a") - F.col("__b")) > tolerance * F.greatest(F.abs("__a"), F.abs("__b"))
    return j.agg(F.count_if(F.col("__r").isNull()).alias("missing"), F.count_if(F.col("__l").isNull()).alias("extra"), F.count_if(off).alias("changed"), F.count("*").alias("keys"))
